"""Classify a device registry: snapshot, precedence rule, three output tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.operators import contracts, registry
from tallymark.session import written
from tallymark.sources.tables import observed, observed_metrics, write_table
from tallymark.vocab import DEVICE_CATEGORIES, DEVICE_EXCLUSIONS


@dataclass(frozen=True)
class RegistryRun:
    labeled: DataFrame

    @property
    def authorizations(self) -> DataFrame:
        return registry.authorizations(self.labeled)

    @cached_property
    def profile(self) -> DataFrame:
        """Counts of the counted devices, stored once; all count tables come from it."""
        return written(registry.profile(self.labeled.where("counted")), "registry-profile")

    @property
    def cumulative(self) -> DataFrame:
        return registry.cumulative_by_year(self.profile)

    @property
    def pathways(self) -> DataFrame:
        return registry.pathway_counts(self.profile)

    def problems(self) -> DataFrame:
        return contracts.cross_table(self.profile, self.cumulative, self.pathways)


def classify_registry(
    devices: DataFrame, lookup: DataFrame, assigned: DataFrame, excluded: DataFrame, decisions: DataFrame
) -> RegistryRun:
    """``devices`` in the frozen raw columns; the other tables are rule tables."""
    enriched = registry.attach_lookup(registry.derive_fields(devices), lookup)
    return RegistryRun(registry.classify_devices(enriched, assigned, excluded, decisions))


def device_counts() -> dict[tuple[str, str], Column]:
    """What is counted while the labeled devices are written."""
    counted, c = F.col("counted"), F.col
    return {
        ("devices_in", ""): F.count(F.lit(1)),
        ("devices_counted", ""): F.count_if(counted),
        **{("devices_excluded", r): F.count_if(c("exclusion_reason") == r) for r in DEVICE_EXCLUSIONS},
        **{("counted_by", b): F.count_if(counted & (c("basis") == b)) for b in ("device", "code")},
        **{("counted_in", k): F.count_if(counted & (c("category") == k)) for k in DEVICE_CATEGORIES},
        ("without_lookup", ""): F.count_if(~c("has_classification")),
        ("code_overridden", ""): F.count_if(counted & c("code_overridden")),
    }


def write_registry(run: RegistryRun, out: str, provenance: dict[str, str]) -> None:
    spark = run.labeled.sparkSession
    labeled, seen = observed(run.labeled, "registry", device_counts())
    write_table(labeled, f"{out}/labeled_devices", provenance)
    write_table(observed_metrics(spark, seen), f"{out}/run_metrics", provenance)
    done = RegistryRun(spark.read.parquet(f"{out}/labeled_devices/data"))
    write_table(done.authorizations, f"{out}/authorizations", provenance)
    write_table(done.cumulative, f"{out}/cumulative_by_year", provenance)
    write_table(done.pathways, f"{out}/pathway_by_domain", provenance)
