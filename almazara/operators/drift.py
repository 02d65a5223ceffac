"""Problem 5: fields that are added, removed, renamed or change type from file to file."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almazara.functions.text import slug
from almazara.session import cut

# The names under which one field is known, by dataset and canonical field.
ALIASES: dict[str, dict[str, tuple[str, ...]]] = {
    "ventas": {
        "article_code": ("article_code", "articulo", "codigo", "cod_articulo", "codigo_articulo"),
        "article_name": ("article_name", "nombre_articulo", "descripcion"),
        "department_code": ("department_code", "cod_departamento_venta", "departamento", "seccion", "codigo_departamento"),
        "units": ("units", "unidades", "cantidad", "uds"),
        "amount": ("amount", "importe", "importe_total", "total_linea", "venta_eur"),
    },
    "eventos": {
        "event_id": ("event_id", "id_evento", "evento_id"),
        "event_name": ("event_name", "evento", "nombre", "nombre_evento", "evento_nombre", "titulo"),
        "event_start": ("event_start", "fecha_inicio", "desde"),
        "event_end": ("event_end", "fecha_fin", "hasta"),
        "event_intensity": ("event_intensity", "intensidad", "intensidad_sugerida", "nivel_intensidad"),
    },
}

#: How the canonical fields are cast: number, text or day.
CASTS: dict[str, dict[str, str]] = {
    "ventas": {"article_code": "long", "article_name": "text", "department_code": "text", "units": "number", "amount": "number"},
    "eventos": {"event_id": "text", "event_name": "text", "event_start": "day", "event_end": "day", "event_intensity": "number"},
}
# Words that stand for an intensity.
WORD_NUMBERS = {"baja": 1.0, "bajo": 1.0, "media": 3.0, "medio": 3.0, "alta": 5.0, "alto": 5.0}


def readable(df: DataFrame) -> DataFrame:
    """Readable lines as (dataset, feed, source_file, file_date, received_at, line_no, record).

    A line that is no JSON object is unreadable; one without feed, file or date belongs to no file.
    """
    rows = df.select("dataset", "feed", "source_file", F.col("file_date").cast("date").alias("file_date"), "received_at", "line_no", F.try_parse_json("payload").alias("record"))
    return rows.where(F.col("feed").isNotNull() & F.col("source_file").isNotNull() & F.col("file_date").isNotNull() & F.col("record").isNotNull() & F.schema_of_variant("record").startswith("OBJECT"))


def records(df: DataFrame) -> DataFrame:
    """The readable lines of the first delivery of each file; deliveries are told apart by received_at."""
    rows = readable(df)
    first = rows.groupBy("feed", "source_file").agg(F.min("received_at").alias("first_at"))
    return rows.join(first, ["feed", "source_file"]).where(F.col("received_at").eqNullSafe(F.col("first_at"))).drop("received_at", "first_at")


def _kind(schema: Column) -> Column:
    return (
        F.when(schema == "VOID", F.lit(None).cast("string"))
        .when(schema.startswith("OBJECT"), "object").when(schema.startswith("ARRAY"), "array")
        .when(schema == "STRING", "string").when(schema == "BOOLEAN", "boolean").otherwise("number")
    )


def footers(lines: DataFrame) -> DataFrame:
    """What a footer would say of each file, exploded: (dataset, feed, source_file, file_date, field_name, kind).

    One row per file and normalised name, from ``readable`` lines; kind is the most frequent type of its non-null
    values (by name on a tie), null if there is none. One pass: fields are counted per delivery, name as written
    and type before the shuffle; names are normalised and the first delivery chosen on those counts. The result
    is written, since the catalogue reads it several times.
    """
    fields = lines.lateralJoin(lines.sparkSession.tvf.variant_explode(F.col("record").outer()).select(F.col("key").alias("raw_name"), F.schema_of_variant("value").alias("shape")))
    raw = fields.groupBy("dataset", "feed", "source_file", "file_date", "received_at", "raw_name", _kind(F.col("shape")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    first = F.min("received_at").over(Window.partitionBy("feed", "source_file"))  # a row a file, delivery, name and type
    named = raw.withColumn("first_at", first).where(F.col("received_at").eqNullSafe(F.col("first_at"))).withColumn("field_name", slug(F.col("raw_name"))).dropna(subset=["field_name"])
    counts = named.groupBy("dataset", "feed", "source_file", "file_date", "field_name", "kind").agg(F.sum("n").alias("n"))
    return cut(counts.groupBy("dataset", "feed", "source_file", "file_date", "field_name").agg(
        F.max_by("kind", F.when(F.col("kind").isNotNull(), F.struct("n", "kind"))).alias("kind")
    ))


def canonical(dataset: Column, field: Column, aliases: Mapping[str, Mapping[str, Sequence[str]]] = ALIASES) -> Column:
    """The canonical name of a field by the alias table; a name outside it is its own."""
    pairs = {f"{d} {name}": c for d, fields in aliases.items() for c, names in fields.items() for name in names}
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.concat_ws(" ", dataset, field)), field)


def _numbered(footer: DataFrame) -> DataFrame:
    """The files of each feed with their place by date."""
    files = footer.select("feed", "source_file", "file_date").distinct()
    return files.select("feed", "source_file", F.row_number().over(Window.partitionBy("feed").orderBy("file_date", "source_file")).alias("no"))


def lifespans(footer: DataFrame, aliases: Mapping[str, Mapping[str, Sequence[str]]] = ALIASES) -> DataFrame:
    """The catalogue: one row per island, a run of consecutive files of a feed that hold a field under one name and type.

    Columns (dataset, feed, line, field_name, kind, first_no, last_no, born, renamed, retyped, old_name,
    old_kind): files are numbered per feed by date. A ``line`` is a canonical field, whose names follow each
    other; where a file holds two names of one canonical field, each name of it is a line of its own in that
    feed. An island begins because the line was absent from the file before (``born``), or had another name
    (``renamed``) or another type (``retyped``). A field null throughout a file keeps the type it had, also
    under a new name; the first type that becomes known is no change.
    """
    canon = canonical(F.col("dataset"), F.col("field_name"), aliases)
    names = footer.withColumn("canon", canon)
    twice = names.groupBy("dataset", "feed", "canon", "source_file").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("dataset", "feed", "canon", F.lit(True).alias("twice")).distinct()
    rows = names.join(twice, ["dataset", "feed", "canon"], "left").join(_numbered(footer), ["feed", "source_file"])
    rows = rows.withColumn("line", F.when(F.col("twice"), F.concat(F.lit("name:"), "field_name")).otherwise(F.concat(F.lit("field:"), "canon")))
    by = Window.partitionBy("dataset", "feed", "line").orderBy("no")
    rows = rows.withColumn("born", F.coalesce(F.lag("no").over(by) != F.col("no") - 1, F.lit(True)))
    rows = rows.withColumn("before", F.lag("field_name").over(by))
    rows = rows.withColumn("renamed", ~F.col("born") & (F.col("before") != F.col("field_name")))
    rows = rows.withColumn("life", F.sum(F.col("born").cast("int")).over(by))
    life = Window.partitionBy("dataset", "feed", "line", "life").orderBy("no")
    rows = rows.withColumn("known", F.last("kind", True).over(life.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("was", F.last("kind", True).over(life.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("retyped", F.coalesce(F.col("known") != F.col("was"), F.lit(False)))
    rows = rows.withColumn("island", F.sum((F.col("born") | F.col("renamed") | F.col("retyped")).cast("int")).over(by))
    return rows.groupBy("dataset", "feed", "line", "island", "field_name").agg(
        F.max_by("known", "no").alias("kind"), F.min("no").alias("first_no"), F.max("no").alias("last_no"),
        F.bool_or("born").alias("born"), F.bool_or("renamed").alias("renamed"), F.bool_or("retyped").alias("retyped"),
        F.min_by("before", "no").alias("old_name"), F.min_by("was", "no").alias("old_kind"),
    )


def changes(footer: DataFrame, aliases: Mapping[str, Mapping[str, Sequence[str]]] = ALIASES) -> DataFrame:
    """The log of starts and endings of islands, as (dataset, feed, source_file, field_name, change_kind, old_name, old_kind, new_kind).

    An island that begins in a later file than the feed's first is ``added`` there, or ``renamed`` (its new
    name) or ``retyped`` or both; a line that ends before the feed's last file is ``removed`` (its last name)
    in the file after.

    Defined edge cases: files without a readable record are no files; one name in several spellings is one
    field; a name empty after normalising is no field; a feed with one file has no changes.
    """
    spans = lifespans(footer, aliases)
    by = Window.partitionBy("dataset", "feed", "line").orderBy("first_no")
    spans = spans.withColumn("ends", F.coalesce(F.lead("first_no").over(by) != F.col("last_no") + 1, F.lit(True)))
    late = F.col("first_no") > 1
    event = lambda cond, kind, no, old: F.when(cond, F.struct(F.lit(kind).alias("kind"), no.alias("no"), old.alias("old")))
    none = F.lit(None).cast("string")
    events = F.array_compact(F.array(
        event(F.col("born") & late, "added", F.col("first_no"), none),
        event(F.col("renamed"), "renamed", F.col("first_no"), F.col("old_name")),
        event(F.col("retyped"), "retyped", F.col("first_no"), none),
        event(F.col("ends"), "removed", F.col("last_no") + 1, F.col("field_name")),
    ))
    log = spans.select("dataset", "feed", "field_name", F.explode(events).alias("e"), "old_kind", F.col("kind").alias("new_kind"))
    log = log.select("dataset", "feed", F.col("e.no").alias("no"), "field_name", F.col("e.kind").alias("change_kind"), F.col("e.old").alias("old_name"), "old_kind", "new_kind")
    return log.join(_numbered(footer), ["feed", "no"]).select("dataset", "feed", "source_file", "field_name", "change_kind", "old_name", "old_kind", "new_kind")


def number(text: Column) -> Column:
    """A number with a decimal point or comma, grouped or not, with currency signs; words of WORD_NUMBERS; else null."""
    bare = F.regexp_replace(F.lower(text), r"[^0-9,.\-]", "")
    comma, point = F.length(F.regexp_replace(bare, "[^,]", "")), F.length(F.regexp_replace(bare, "[^.]", ""))
    last_comma = F.instr(F.reverse(bare), ",")
    last_point = F.instr(F.reverse(bare), ".")
    plain = (
        F.when((comma > 0) & ((point == 0) | (last_comma < last_point)), F.regexp_replace(F.regexp_replace(bare, r"\.", ""), ",", "."))
        .when((comma > 0) | (point > 1), F.regexp_replace(bare, ",", ""))
        .otherwise(bare)
    )
    words = F.create_map(*[F.lit(x) for kv in WORD_NUMBERS.items() for x in kv])
    return F.coalesce(F.nullif(plain, F.lit("")).try_cast("double"), F.try_element_at(words, F.trim(F.lower(text))))


def _scalar(v: Column, kind: Column) -> Column:
    """The text of a value however it is wrapped: an object's ``valor``, ``es``, ``cod`` or ``nombre``, an array's first element."""
    get = lambda path: F.try_variant_get(v, path, "string")
    return F.when(kind == "object", F.coalesce(get("$.valor"), get("$.es"), get("$.cod"), get("$.nombre"))).when(kind == "array", get("$[0]")).otherwise(get("$"))


def consistent(recs: DataFrame, dataset: str, aliases: Mapping[str, Mapping[str, Sequence[str]]] = ALIASES, casts: Mapping[str, Mapping[str, str]] = CASTS) -> DataFrame:
    """All records of a dataset as one table: keys, one column per canonical field, and ``other`` for the rest.

    The casts are generated from the alias table, as projections of each record; only records that are doubled
    within a file meet in a shuffle, by a digest of their content. Where a record has several names of one
    canonical field, the one that comes first in the alias table counts (of spellings of one name the first by
    alphabet) if it isn't null.

    Nothing is dropped: the map ``other`` holds, by normalised name (as written, if two fall together), the text
    of every non-null field that no column has in full: fields outside the table, names that lost, values
    that don't fit their cast (null in the column), and objects and arrays, of which the column takes one part.
    """
    wanted = dict(aliases[dataset])
    place = {n: (c, i) for c, names in wanted.items() for i, n in enumerate(names)}
    rank = F.create_map(*[F.lit(x) for n, (_, i) in place.items() for x in (n, i)])
    canon = F.create_map(*[F.lit(x) for n, (c, _) in place.items() for x in (n, c)])

    def entry(e: Column) -> Column:
        name, kind = slug(e["key"]), _kind(F.schema_of_variant(e["value"]))
        return F.struct(
            F.try_element_at(rank, name).alias("rank"), e["key"].alias("raw"), name.alias("name"), F.try_element_at(canon, name).alias("canon"), _scalar(e["value"], kind).alias("text"),
            F.try_variant_get(e["value"], "$", "string").alias("whole"), kind.isin("object", "array").alias("wrapped"),
        )

    rows = recs.where(F.col("dataset") == dataset).select("feed", "source_file", "file_date", "line_no", F.to_json("record").alias("body"))
    rows = rows.select("feed", "source_file", "file_date", "line_no", F.sha2("body", 256).alias("digest"), F.from_json("body", "map<string,variant>").alias("m"))
    rows = rows.select("feed", "source_file", "file_date", "line_no", "digest", F.filter(F.transform(F.map_entries("m"), entry), lambda f: f["whole"].isNotNull()).alias("fields"))
    of = lambda c: lambda f: (f["canon"] == c) & f["text"].isNotNull()
    rows = rows.withColumns({f"best_{c}": F.array_min(F.filter("fields", of(c))) for c in wanted})
    how = {
        "text": lambda c: F.nullif(F.trim(c), F.lit("")), "number": number, "long": lambda c: F.trim(c).try_cast("long"),
        "day": lambda c: F.trim(c).try_cast("date"),
    }
    rows = rows.withColumns({c: how[casts[dataset][c]](F.col(f"best_{c}")["text"]) for c in wanted})

    def told(f: Column) -> Column:
        """Whether a column has all a field says."""
        full = [(f["canon"] == c) & ~f["wrapped"] & (f["raw"] == F.col(f"best_{c}")["raw"]) & (F.col(c).isNotNull() | (F.trim(f["text"]) == "")) for c in wanted]
        return F.coalesce(reduce(lambda a, b: a | b, full), F.lit(False))

    rest = rows.withColumn("rest", F.filter("fields", lambda f: ~told(f)))
    alone = lambda f: F.size(F.filter("rest", lambda g: g["name"] == f["name"])) == 1
    other = F.map_from_entries(F.transform("rest", lambda f: F.struct(F.when(alone(f), f["name"]).otherwise(f["raw"]).alias("key"), f["whole"].alias("value"))))
    one = rest.select("feed", "source_file", "file_date", "line_no", "digest", F.struct(*wanted, other.alias("other")).alias("r"))
    once = one.groupBy("feed", "source_file", "file_date", "digest").agg(F.min("line_no").alias("line_no"), F.first("r").alias("r"))  # equal content, so any will do
    return once.select("feed", "source_file", "file_date", "line_no", *[F.col("r")[c].alias(c) for c in wanted], F.col("r")["other"].alias("other"))
