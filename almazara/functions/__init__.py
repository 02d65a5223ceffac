"""Column functions: text folding, casts, calendars."""
