"""Run options, rules and paths, validated on creation."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields

from pyspark.sql import SparkSession

from almazara.sources import files


def _positive(o: object, *names: str) -> None:
    for n in names:
        if getattr(o, n) <= 0:
            raise ValueError(f"{n} must be positive")


def _fraction(o: object, *names: str) -> None:
    for n in names:
        if not 0 <= getattr(o, n) <= 1:
            raise ValueError(f"{n} must lie between 0 and 1")


@dataclass(frozen=True)
class RunOptions:
    do_ingest: bool = True
    do_depuration: bool = True
    do_eda: bool = True
    do_features: bool = True
    do_modeling: bool = True
    do_operational: bool = True
    strict_ingestion: bool = False
    recursive_raw_scan: bool = False
    source_when_ingest_disabled: str = "auto"

    def __post_init__(self) -> None:
        if not any(getattr(self, f.name) for f in fields(self) if f.name.startswith("do_")):
            raise ValueError("at least one stage must run")
        if self.do_ingest and not self.do_depuration and (self.do_eda or self.do_features or self.do_modeling or self.do_operational):
            raise ValueError("newly ingested data must be cleaned before any later stage")
        if self.do_depuration and not self.do_features and (self.do_modeling or self.do_operational):
            raise ValueError("newly cleaned data need new features before models or a forecast")
        if self.do_features and not self.do_modeling and self.do_operational:
            raise ValueError("new features need new models before a forecast")
        if self.source_when_ingest_disabled not in ("auto", "bronze", "structured"):
            raise ValueError("source_when_ingest_disabled is auto, bronze or structured")


@dataclass(frozen=True)
class CleaningRules:
    drop_exact_duplicates: bool = True
    drop_rows_missing_required_keys: bool = True
    auto_impute_low_missingness: bool = True
    max_missing_fraction: float = 0.05
    categorical_missing_label: str = "UNKNOWN"
    detect_outliers: bool = True
    iqr_multiplier: float = 1.5
    robust_z_threshold: float = 3.5
    min_rows_for_outliers: int = 8
    min_unique_for_outliers: int = 5
    large_group_people: int = 8
    reconciliation_tolerance: float = 0.02

    def __post_init__(self) -> None:
        _fraction(self, "max_missing_fraction")
        _positive(self, "iqr_multiplier", "robust_z_threshold", "min_rows_for_outliers", "min_unique_for_outliers", "large_group_people")


@dataclass(frozen=True)
class IntegrationRules:
    build_daily: bool = True
    build_panel: bool = True
    keep_invitations: bool = True
    prefer_tickets: bool = True
    shifts: tuple[str, ...] = ("comida", "cena")
    statuses: tuple[str, ...] = ()
    expected_days_weight: str = "rows"

    def __post_init__(self) -> None:
        if not (self.build_daily or self.build_panel):
            raise ValueError("at least one gold table must be built")
        if self.expected_days_weight not in ("rows", "periods"):
            raise ValueError("expected_days_weight is rows or periods")


@dataclass(frozen=True)
class EDARules:
    most_categories: int = 30
    top_categories: int = 15
    min_pairs: int = 20
    top_correlations: int = 25
    leakage: float = 0.995
    low_activity: float = 0.25
    min_weekdays: int = 4

    def __post_init__(self) -> None:
        _positive(self, "most_categories", "top_categories", "min_pairs", "top_correlations", "min_weekdays")
        _fraction(self, "leakage", "low_activity")


@dataclass(frozen=True)
class FutureContextRules:
    include_events: bool = True
    include_holidays: bool = True
    include_weather: bool = True


@dataclass(frozen=True)
class FeatureRules:
    daily_lags: tuple[int, ...] = (1, 7, 14, 28)
    daily_rolling_windows: tuple[int, ...] = (7, 14, 28)
    article_lags: tuple[int, ...] = (1, 2, 4, 8)
    article_rolling_windows: tuple[int, ...] = (4, 8)
    min_history: int = 4
    frequent: float = 0.75
    regular: float = 0.5
    intermittent: float = 0.25

    def __post_init__(self) -> None:
        for n in ("daily_lags", "daily_rolling_windows", "article_lags", "article_rolling_windows"):
            if not getattr(self, n) or min(getattr(self, n)) < 1:
                raise ValueError(f"{n} must hold positive numbers")
        if not 1 >= self.frequent >= self.regular >= self.intermittent >= 0:
            raise ValueError("regime thresholds must fall")


@dataclass(frozen=True)
class ModelingRules:
    final_test_fraction: float = 0.15
    min_final_test_periods: int = 2
    cv_splits: int = 4
    cv_validation_fraction: float = 0.1
    min_train_periods: int = 8
    top_k: int = 20
    candidates: tuple[str, ...] = ("poisson_glm", "random_forest")
    trees: int = 300
    adaptive_min_regime_rows: int = 20
    adaptive_min_global_rows: int = 50
    default_model: str = "expanding_mean"
    evaluate_final_test: bool = True
    identifiers: tuple[str, ...] = ("department_code",)

    def __post_init__(self) -> None:
        _fraction(self, "final_test_fraction", "cv_validation_fraction")
        _positive(self, "min_final_test_periods", "cv_splits", "min_train_periods", "top_k", "trees")


@dataclass(frozen=True)
class OperationalRules:
    abc_threshold_a: float = 0.8
    abc_threshold_b: float = 0.95

    def __post_init__(self) -> None:
        _fraction(self, "abc_threshold_a", "abc_threshold_b")
        if self.abc_threshold_a > self.abc_threshold_b:
            raise ValueError("threshold a must not exceed b")


@dataclass(frozen=True)
class Paths:
    """The folders of a project; layers live below ``root``."""

    root: str
    raw: str = "data/raw"

    def of(self, layer: str) -> str:
        return os.path.join(self.root, self.raw if layer == "raw" else f"data/{layer}" if layer in ("bronze", "silver", "gold", "features") else layer)

    def prepare(self, spark: SparkSession) -> None:
        for layer in ("bronze", "silver", "gold", "features", "reports"):
            files.make_folder(spark, self.of(layer))


@dataclass(frozen=True)
class PipelineConfig:
    paths: Paths
    options: RunOptions = field(default_factory=RunOptions)
    cleaning: CleaningRules = field(default_factory=CleaningRules)
    features: FeatureRules = field(default_factory=FeatureRules)
    modeling: ModelingRules = field(default_factory=ModelingRules)
    operational: OperationalRules = field(default_factory=OperationalRules)
    integration: IntegrationRules = field(default_factory=IntegrationRules)
    eda: EDARules = field(default_factory=EDARules)
    future: FutureContextRules = field(default_factory=FutureContextRules)
    structured_inputs: dict[str, str] = field(default_factory=dict)
    weather_forecast: str | None = None

    def source(self) -> str:
        """Where a run without ingestion takes its tables from."""
        if self.options.do_ingest:
            return "raw"
        choice = self.options.source_when_ingest_disabled
        if choice == "auto":
            return "structured" if self.structured_inputs else "bronze"
        return choice

    def problems(self, spark: SparkSession) -> list[str]:
        """What is missing for the chosen stages: raw or structured inputs, and the layers that no stage makes anew."""
        out, o = [], self.options
        there = lambda layer: any(n.endswith(".parquet") for n in files.names(spark, self.paths.of(layer)))
        if o.do_ingest and not files.exists(spark, self.paths.of("raw")):
            out.append("the raw folder is missing")
        elif o.do_depuration and not o.do_ingest and self.source() == "bronze" and not there("bronze"):
            out.append("there is no bronze layer to clean")
        if not o.do_ingest and self.source() == "structured":
            out += [f"{n}: {p} is missing" for n, p in self.structured_inputs.items() if not files.exists(spark, p)]
            if o.do_depuration and not self.structured_inputs:
                out.append("no structured inputs are named")
        if not o.do_depuration and (o.do_features or o.do_eda or o.do_operational) and not there("gold"):
            out.append("there is no gold layer")
        if not o.do_features and (o.do_modeling or o.do_operational) and not there("features"):
            out.append("there are no feature tables")
        if o.do_operational and not o.do_modeling and not files.exists(spark, os.path.join(self.paths.of("reports"), "model_frozen_mapping.parquet")):
            out.append("there is no frozen mapping")
        if self.weather_forecast and not files.exists(spark, self.weather_forecast):
            out.append("the weather forecast is missing")
        return out

    def summary(self) -> dict:
        return {"root": self.paths.root, "source": self.source(), "stages": [f.name[3:] for f in fields(self.options) if f.name.startswith("do_") and getattr(self.options, f.name)]}
