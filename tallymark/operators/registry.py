"""The device registry: derived fields, the precedence rule, and its reports.

Devices may be any number of rows; codes, exclusions and decisions are rule tables and
are broadcast after a size check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.dates import decision_date, iso_or_blank
from tallymark.functions.labels import prefix_class
from tallymark.functions.rates import rate
from tallymark.operators.grids import dense_counts, each, running_total, zero_filled
from tallymark.operators.joins import one_row, or_zero, small
from tallymark.vocab import (
    IN_SCOPE_PANELS,
    PARTIAL_YEAR_BEFORE_MONTH,
    PATHWAY_PREFIXES,
    PATHWAYS,
)

DEVICE_COLUMNS = {
    "Submission Number": "submission_number",
    "Device": "device",
    "Company": "company",
    "Panel (Lead)": "panel_lead",
    "Primary Product Code": "product_code",
}
DATE_COLUMN = "Date of Final Decision"
AUTHORIZATION_COLUMNS = (
    "submission_number", "decision_date", "year", "device", "company", "panel_lead",
    "product_code", "domain", "category", "category_label", "pathway", "regulation_number",
)
LOOKUP_PREFIX = "openfda_"


def blank(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def derive_fields(devices: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    """Rename, trim, and add decision date, year and pathway."""
    named = devices.withColumnsRenamed(DEVICE_COLUMNS)
    parsed = decision_date(DATE_COLUMN)
    return named.select(
        *[F.trim(blank(c)).alias(c) for c in DEVICE_COLUMNS.values()],
        iso_or_blank(parsed).alias("decision_date"),
        F.year(parsed).alias("year"),
        prefix_class("submission_number", prefixes or PATHWAY_PREFIXES).alias("pathway"),
    )


def attach_lookup(devices: DataFrame, lookup: DataFrame, key: str = "product_code") -> DataFrame:
    """Left join of a lookup under a prefix, with a flag saying whether a row was found."""
    fields = [c for c in lookup.columns if c != key]
    side = lookup.select(
        key, *[F.col(c).alias(f"{LOOKUP_PREFIX}{c}") for c in fields], F.lit(True).alias("_found")
    )
    return devices.join(small(side), key, "left").withColumn(
        "has_classification", F.coalesce("_found", F.lit(False))
    ).drop("_found")


def codes_without_record(devices: DataFrame, lookup: DataFrame, key: str = "product_code") -> DataFrame:
    """Codes in use that the lookup does not know, with device counts."""
    used = devices.where(F.col(key) != "").groupBy(key).agg(F.count("*").alias("n_devices"))
    return used.join(lookup.select(key), key, "left_anti")


def classify_devices(
    devices: DataFrame, assigned: DataFrame, excluded: DataFrame, decisions: DataFrame
) -> DataFrame:
    """Apply the precedence rule to every device.

    ``assigned``: code, category, domain, category_label, regulation_number, overridden.
    ``excluded``: code, group.  ``decisions``: submission_number, decision, category, confidence.
    A decision on the device itself outranks its code; the code outranks the exclusion list;
    a row that would count but lacks a pathway or a date is excluded for that.  A code or device that a table
    lists twice does not multiply devices; the contracts report it.
    """
    labels = assigned.select("category", "domain", "category_label").distinct()
    code = assigned.select(
        F.col("code").alias("product_code"),
        F.col("category").alias("code_category"),
        F.col("domain").alias("code_domain"),
        F.col("category_label").alias("code_label"),
        F.col("regulation_number").alias("code_regulation"),
        "overridden",
    )
    dropped = excluded.select(F.col("code").alias("product_code"), F.col("group").alias("excluded_group"))
    decided = decisions.select(
        F.upper(F.trim("submission_number")).alias("_device_key"),
        "decision",
        F.col("category").alias("decided_category"),
        "confidence",
    ).join(
        small(
            labels.select(
                F.col("category").alias("decided_category"),
                F.col("domain").alias("decided_domain"),
                F.col("category_label").alias("decided_label"),
            )
        ),
        "decided_category",
        "left",
    )
    joined = (
        devices.withColumn("_device_key", F.upper(F.trim("submission_number")))
        .join(small(one_row(decided, "_device_key", [])), "_device_key", "left")
        .join(small(one_row(code, "product_code", [])), "product_code", "left")
        .join(small(one_row(dropped, "product_code", [])), "product_code", "left")
    )
    c = F.col
    qualifies = F.when(c("decision").isNotNull(), c("decision") == "oncology").otherwise(
        c("code_category").isNotNull()
    )
    reason = (
        F.when(qualifies & (c("pathway") == ""), "pathway_unknown")
        .when(qualifies & (c("decision_date") == ""), "no_decision_date")
        .when(qualifies, "")
        .when(c("decision").isNotNull(), F.concat(F.lit("device_"), c("decision")))
        .when(c("excluded_group").isNotNull(), F.concat(F.lit("code_"), c("excluded_group")))
        .when(c("panel_lead").isin(*IN_SCOPE_PANELS), "code_unlisted_in_panel")
        .otherwise("code_unlisted_off_panel")
    )
    staged = joined.withColumn("exclusion_reason", reason)
    counted = c("exclusion_reason") == ""
    by_device = counted & (blank("decided_category") != "")

    def when_counted(device: str, from_code: str) -> Column:
        return F.when(by_device, blank(device)).when(counted, blank(from_code)).otherwise("")

    extra = [x for x in devices.columns if x.startswith(LOOKUP_PREFIX)]
    return staged.select(
        "submission_number",
        "decision_date",
        "year",
        "device",
        "company",
        "panel_lead",
        "product_code",
        when_counted("decided_domain", "code_domain").alias("domain"),
        when_counted("decided_category", "code_category").alias("category"),
        when_counted("decided_label", "code_label").alias("category_label"),
        F.when(counted, c("pathway")).otherwise("").alias("pathway"),
        # a device counted by decision keeps its code's number if the code is assigned
        F.when(counted, blank("code_regulation")).otherwise("").alias("regulation_number"),
        counted.alias("counted"),
        F.when(by_device, "device").when(counted, "code").otherwise("").alias("basis"),
        F.when(by_device, blank("confidence")).otherwise("").alias("adjudication_confidence"),
        "exclusion_reason",
        F.coalesce("overridden", F.lit(False)).alias("code_overridden"),
        *(["has_classification"] if "has_classification" in devices.columns else []),
        *[blank(x).alias(x) for x in extra],
    )


def authorizations(labeled: DataFrame) -> DataFrame:
    """Counted devices in the frozen columns and a stable order."""
    return labeled.where("counted").select(*AUTHORIZATION_COLUMNS).orderBy(
        "decision_date", "submission_number"
    )


def profile(auth: DataFrame) -> DataFrame:
    """Counts by all that the count tables group by; stored, they come from a few rows instead of the registry."""
    return auth.groupBy("domain", "category", "pathway", "year").agg(F.count("*").alias("n_devices"))


def _n(auth: DataFrame) -> Column:
    """Devices in a group of the registry, or of a :func:`profile` of it."""
    return F.sum("n_devices") if "n_devices" in auth.columns else F.count("*")


def cumulative_by_year(auth: DataFrame, years: tuple[int, int] | None = None) -> DataFrame:
    """Dense annual counts per category with a running total."""
    counts = auth.groupBy("category", "domain", "year").agg(_n(auth).alias("annual_count"))
    dense = dense_counts(counts, ["category", "domain"], "annual_count", years)
    return running_total(dense, ["category", "domain"], "year", "annual_count", "cumulative_count").select(
        "year", "category", "domain", "annual_count", "cumulative_count"
    )


def sparse_running_total(auth: DataFrame, by: str = "domain") -> DataFrame:
    """Running total over only the years that have a count."""
    counts = auth.groupBy(by, "year").agg(F.count("*").alias("annual_count"))
    return running_total(counts, by, "year", "annual_count", "cumulative_count")


def pathway_counts(auth: DataFrame, pathways: tuple[str, ...] = PATHWAYS) -> DataFrame:
    """Counts per domain, category and pathway, zeros filled over the fixed pathway list."""
    counts = auth.groupBy("domain", "category", "pathway").agg(_n(auth).alias("count"))
    grid = each(counts.select("domain", "category").distinct(), "pathway", pathways)
    return zero_filled(grid, counts, ["domain", "category", "pathway"], "count")


def reason_counts(labeled: DataFrame, reasons) -> DataFrame:
    from tallymark.operators.counts import exclusion_counts

    return exclusion_counts(
        labeled.select(F.nullif(F.col("exclusion_reason"), F.lit("")).alias("reason")), reasons
    )


def code_counts(devices: DataFrame, codes: DataFrame) -> DataFrame:
    """Devices per listed code, over all devices, zeros kept."""
    found = devices.groupBy(F.col("product_code").alias("code")).agg(F.count("*").alias("n"))
    return codes.select("code").distinct().join(found, "code", "left").select("code", or_zero("n").alias("n"))


def tally(labeled: DataFrame) -> DataFrame:
    """Counted devices by basis, category and domain x pathway, one grouped pass."""
    counts = labeled.where("counted").groupBy("basis", "domain", "category", "pathway").agg(
        F.count("*").alias("n")
    )
    c = F.col
    entry = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    keys = F.array(
        entry("basis", c("basis")),
        entry("category", c("category")),
        entry("domain_pathway", F.concat_ws("/", "domain", "pathway")),
    )
    return counts.select("n", F.explode(keys).alias("k")).groupBy("k.kind", "k.key").agg(
        F.sum("n").alias("n")
    )


def panel_agreement(labeled: DataFrame) -> DataFrame:
    """Per domain: devices, how many carry the matching lead panel, and the rate."""
    match = F.lower("panel_lead") == F.lower("domain")
    return (
        labeled.where("counted")
        .groupBy("domain")
        .agg(F.count("*").alias("n_devices"), F.count_if(match).alias("n_panel_matches"))
        .withColumn("rate", F.coalesce(rate("n_panel_matches", "n_devices"), F.lit(0.0)))
    )


def other_panels(labeled: DataFrame) -> DataFrame:
    return (
        labeled.where("counted")
        .where(F.lower("panel_lead") != F.lower("domain"))
        .groupBy("domain", "panel_lead")
        .agg(F.count("*").alias("n_devices"))
    )


def specialty_disagreements(assigned: DataFrame, lookup: DataFrame, field: str) -> DataFrame:
    """Assigned codes whose looked-up specialty does not confirm the assigned domain."""
    side = lookup.select(F.col("product_code").alias("code"), F.col(field).alias("_s"), F.lit(1).alias("_r"))
    stated = F.trim(blank("_s"))
    kind = (
        F.when(F.col("_r").isNull(), "no_record")
        .when(F.lower(stated).isin("", "unknown"), "unstated")
        .otherwise("conflict")
    )
    return (
        assigned.select("code", "category", "domain")
        .join(side, "code", "left")
        .where(F.lower(stated) != F.lower("domain"))
        .select(
            "code",
            "category",
            F.col("domain").alias("config_domain"),
            F.coalesce(F.nullif(stated, F.lit("")), F.lit("(no record)")).alias("lookup_specialty"),
            kind.alias("kind"),
        )
    )


def regulation_differences(assigned: DataFrame, lookup: DataFrame, field: str) -> DataFrame:
    """Assigned codes whose regulation number differs from the lookup, or is overridden."""
    side = lookup.select(F.col("product_code").alias("code"), F.col(field).alias("_l"))
    ours, theirs = F.nullif(blank("regulation_number"), F.lit("")), F.nullif(blank("_l"), F.lit(""))
    flag = F.when(ours != theirs, "differs").when(F.col("overridden"), "override")
    return (
        assigned.join(side, "code", "left")
        .select(
            "code",
            F.coalesce(ours, F.lit("-")).alias("config_regulation"),
            F.coalesce(theirs, F.lit("-")).alias("lookup_regulation"),
            flag.alias("flag"),
        )
        .where("flag is not null")
    )


def excluded_code_drift(devices: DataFrame, excluded: DataFrame) -> DataFrame:
    """Excluded codes whose device count is not the count recorded with the exclusion."""
    seen = code_counts(devices, excluded).withColumnRenamed("n", "observed_n")
    return (
        excluded.select("code", "group", F.col("n").alias("config_n"))
        .join(seen, "code")
        .where("config_n <> observed_n")
    )


def scope_coverage(labeled: DataFrame) -> DataFrame:
    """On the in-scope panels: counted, excluded by a named code or decision, and gaps."""
    inside = labeled.where(F.col("panel_lead").isin(*IN_SCOPE_PANELS))
    gap = F.col("exclusion_reason") == "code_unlisted_in_panel"
    return inside.agg(
        F.count("*").alias("n_devices"),
        F.count_if("counted").alias("n_counted"),
        F.count_if(~F.col("counted") & ~gap).alias("n_excluded"),
        F.count_if(gap).alias("n_unlisted"),
    )


def unlisted_codes(labeled: DataFrame) -> DataFrame:
    """Codes on in-scope panels that no list mentions, with counts and one example."""
    return (
        labeled.where("exclusion_reason = 'code_unlisted_in_panel'")
        .groupBy("product_code")
        .agg(F.count("*").alias("n_devices"), F.min("device").alias("example"))
    )


def snapshot_date(devices: DataFrame) -> DataFrame:
    """Latest parsable decision date and how many do not parse; no row if none does."""
    parsed = decision_date(DATE_COLUMN)
    return devices.agg(
        F.max(parsed).alias("snapshot_date"),
        F.count_if(parsed.isNull()).alias("n_unparsable"),
        F.count("*").alias("n_rows"),
    ).where("snapshot_date is not null")


def partial_year(auth: DataFrame) -> DataFrame:
    """The last year, if the latest decision falls short of its final month; else null."""
    last = auth.agg(F.max("year").alias("y"), F.max(F.to_date("decision_date")).alias("d"))
    short = (F.year("d") < F.col("y")) | (F.month("d") < PARTIAL_YEAR_BEFORE_MONTH)
    return last.select(F.when(short, F.col("y")).alias("partial_year"))


def domain_pathway_share(pathways: DataFrame) -> DataFrame:
    """Pathway counts summed over a domain's categories, with their share of the domain."""
    from tallymark.operators.counts import share_of

    summed = pathways.groupBy("domain", "pathway").agg(F.sum("count").alias("count"))
    return share_of(summed, ["domain"], "count")


def series_finals(cumulative: DataFrame) -> DataFrame:
    """Per category: final running total and the first year it reached one."""
    return cumulative.groupBy("category", "domain").agg(
        F.max_by("cumulative_count", "year").alias("final"),
        F.min(F.when(F.col("cumulative_count") >= 1, F.col("year"))).alias("first_year"),
    )
