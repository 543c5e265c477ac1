"""Quality gates: each gives rows (check, passed, value, expected); a release passes if all do. One aggregation a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackengine.functions.columns import epoch_hours
from trackengine.sources import digests

SCHEMA = "check string, passed boolean, value long, expected long"


def _stack(row: DataFrame, checks: dict[str, int]) -> DataFrame:
    """One-row counts (columns named as the checks) to gate rows."""
    entries = F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).cast("long").alias("value"), F.lit(e).cast("long").alias("expected")) for n, e in checks.items()))
    rows = row.select(F.explode(entries).alias("g")).select("g.*")
    return rows.select("check", (F.col("value") == F.col("expected")).alias("passed"), "value", "expected")


def row_gates(points: DataFrame, expected: dict[str, int], required: list[str], key: str = "track_id", parent: str = "parent_id", event: str = "event_id") -> DataFrame:
    """Row and identity counts against ``expected`` (rows, tracks, parents, observed), and rules that must have no exception."""
    observed, flagged = F.col("position_source") == "observed", F.col("candidate_diagnostics_available")
    zero: dict[str, Column] = {
        "identity_misaligned": F.count_if((F.col(key) != F.col(parent)) | (F.col(key) != F.col(event))),
        "flag_mismatch": F.count_if(observed != flagged),
        "observed_without_class": F.count_if(observed & F.col("category").isNull()),
        "interpolated_with_class": F.count_if(~observed & F.col("category").isNotNull()),
        **{f"null_{c}": F.count_if(F.col(c).isNull()) for c in required},
    }
    counts = {"rows": F.count("*"), "tracks": F.count_distinct(key), "parents": F.count_distinct(parent), "observed": F.count_if(observed)}
    row = points.agg(*(c.alias(n) for n, c in {**counts, **zero}.items()))
    return _stack(row, {**{n: expected[n] for n in counts}, **dict.fromkeys(zero, 0)})


def duplicate_gate(points: DataFrame, keys: list[str], name: str) -> DataFrame:
    row = points.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").agg(F.count("*").alias(name))
    return _stack(row, {name: 0})


def interleaving_gate(stepped: DataFrame, parent: str = "parent_id", key: str = "track_id") -> DataFrame:
    """Inside a parent, changes of segment + 1 must equal its number of segments."""
    per = stepped.groupBy(parent).agg(F.count_if(~F.col("within_segment")).alias("changes"), F.count_distinct(key).alias("segments"))
    return _stack(per.agg(F.count_if(F.col("changes") + 1 != F.col("segments")).alias("interleaved_segments")), {"interleaved_segments": 0})


def alignment_gate(series: DataFrame, columns: list[str]) -> DataFrame:
    """All arrays of a track have one length, and it isn't 0."""
    same = F.size(columns[0]) > 0
    for c in columns[1:]:
        same &= F.size(c) == F.size(columns[0])
    return _stack(series.agg(F.count_if(~same).alias("misaligned_series")), {"misaligned_series": 0})


def file_gate(spark: SparkSession, path: str, digest: str) -> DataFrame:
    """SHA-256 of a file against the published one."""
    return _stack(digests.file_digests(spark, path).agg(F.count_if(F.col("sha256") != digest).alias("fingerprint_mismatch")), {"fingerprint_mismatch": 0})


def published_gate(manifest: DataFrame, metadata: DataFrame, qa: DataFrame, audit: DataFrame, amendment: DataFrame, crosswalk: DataFrame, schemas: dict[str, str], version: str) -> DataFrame:
    """The six documents of one release: schema and version texts, passing reports, and an amendment that changes nothing.

    ``schemas`` has the manifest's and the crosswalk's; a document that lacks a field fails its check."""
    bad = lambda docs, test, name: docs.agg(F.count_if(~F.coalesce(test, F.lit(False))).alias(name))
    unchanged = ~F.col("scientific_change") & ~F.col("catalogue_changed")
    checks = [
        bad(manifest, F.col("schema") == schemas["manifest"], "manifest_schema"),
        bad(metadata, F.col("version") == version.removeprefix("v"), "metadata_version"),
        bad(metadata, F.col("qa.all_release_gates_passed"), "metadata_gates"),
        bad(qa, F.col("status") == "pass", "qa_status"),
        bad(audit, F.col("status") == "pass", "audit_status"),
        bad(amendment, unchanged, "amendment_changes"),
        bad(crosswalk, F.col("schema") == schemas["crosswalk"], "crosswalk_schema"),
        bad(crosswalk, F.col("catalogue_version") == version, "crosswalk_version"),
        manifest.select(F.col("catalogue.sha256").alias("a")).crossJoin(metadata.select(F.col("sha256").alias("b"))).agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("digests_differ")),
    ]  # one row each
    out = None
    for one in checks:
        out = one if out is None else out.crossJoin(one)
    return _stack(out, dict.fromkeys(out.columns, 0))


def document_gate(documents: DataFrame, schema: str, version: str) -> DataFrame:
    """Release documents: schema and version texts, status pass, complete hourly spans, no other step."""
    bad = {
        "schema": F.count_if(~F.col("schema").eqNullSafe(F.lit(schema))),
        "version": F.count_if(~F.col("version").eqNullSafe(F.lit(version))),
        "status": F.count_if(~F.col("status").eqNullSafe(F.lit("pass"))),
        "incomplete_spans": F.count_if(~F.coalesce("continuity.complete_hourly_spans", F.lit(False))),
        "non_hourly_steps": F.coalesce(F.sum("continuity.non_hourly_steps"), F.lit(0)),
        "scientific_change": F.count_if(F.coalesce("scientific_change", F.lit(False))),
    }
    return _stack(documents.agg(*(c.alias(n) for n, c in bad.items())), dict.fromkeys(bad, 0))


def scoreboard(points: DataFrame, tracks: DataFrame, matches: DataFrame, means: DataFrame, key: str = "track_id", parent: str = "parent_id") -> DataFrame:
    """The build's counts in one row; every part is one row, so the joins are of single rows."""
    a = points.agg(
        F.count_distinct(parent).alias("tracks"), F.count_distinct(key).alias("segments"), F.count("*").alias("rows"), F.count_if("observed").alias("observed_rows"), F.count_if(~F.col("observed")).alias("posterior_rows")
    )
    b = points.groupBy(parent, "time").agg(F.count("*").alias("n")).filter("n > 1").agg(F.count("*").alias("duplicates"))
    c = tracks.agg(F.sum("break_count").alias("splits"))
    d = matches.agg(F.count("*").alias("matched"), F.count_if(F.col("confidence").isin("high", "medium") & (F.coalesce("display", F.lit("")) != "")).alias("named"))
    e = means.agg(F.count_distinct("slug").alias("regions"), F.count_distinct(F.when(F.col("mean") >= 0, F.col("track_id"))).alias("tracks_with_rain"))
    return a.crossJoin(b).crossJoin(c).crossJoin(d).crossJoin(e)


def splits_gate(tracks: DataFrame) -> DataFrame:
    return _stack(tracks.agg(F.coalesce(F.sum("break_count"), F.lit(0)).alias("publication_splits")), {"publication_splits": 0})


def hourly_axis_gate(points: DataFrame, key: str = "track_id") -> DataFrame:
    """Rows of a track fill its span, and no step differs from one hour."""
    hours = epoch_hours(F.col("time"))
    rows = points.withColumn("h", hours).withColumn("step", F.col("h") - F.lag("h").over(Window.partitionBy(key).orderBy("time")))
    per = rows.groupBy(key).agg(F.count("*").alias("n"), (F.max("h") - F.min("h") + 1).alias("span"), F.count_if(F.col("step") != 1).alias("odd"))
    return _stack(per.agg(F.count_if(F.col("n") != F.col("span")).alias("incomplete_axes"), F.coalesce(F.sum("odd"), F.lit(0)).alias("non_hourly_steps")), {"incomplete_axes": 0, "non_hourly_steps": 0})


def null_gate(points: DataFrame, columns: list[str]) -> DataFrame:
    return _stack(points.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns)), dict.fromkeys(columns, 0))


def uid_gate(points: DataFrame, uid: str, observed: Column) -> DataFrame:
    """Observed rows have a uid, and no two the same."""
    seen = points.filter(observed)
    twice = seen.filter(F.col(uid).isNotNull()).groupBy(uid).agg(F.count("*").alias("n")).filter("n > 1").agg(F.count("*").alias("duplicate_uid"))
    return _stack(seen.agg(F.count_if(F.col(uid).isNull()).alias("null_uid")), {"null_uid": 0}).unionByName(_stack(twice, {"duplicate_uid": 0}))


def gap_contract(filled: DataFrame, decisions: DataFrame, methods: tuple[str, ...], columns: list[str], most: int, key: str = "track_id") -> DataFrame:
    """Every published gap row has an audit id, an allowed method and complete fields, is in no rejected block, and the unsupported run is held."""
    # a task's blocks are hashed, the rows, which are many more, are not sorted
    judged = filled.join(decisions.select(key, "block", "keep", "longest_bad").hint("shuffle_hash"), [key, "block"], "left")
    nulls = F.lit(False)
    for c in columns:
        nulls |= F.col(c).isNull()
    bad = {
        "without_audit_id": F.count_if(F.col("audit_id").isNull()),
        "method_not_allowed": F.count_if(~F.coalesce(F.col("method").isin(*methods), F.lit(False))),
        "incomplete_fields": F.count_if(nulls),
        "in_rejected_block": F.count_if(~F.coalesce("keep", F.lit(False))),
        "long_unsupported_run": F.count_if((F.col("longest_bad") > most) & (F.col("missing") > 6)),
    }
    return _stack(judged.agg(*(c.alias(n) for n, c in bad.items())), dict.fromkeys(bad, 0))


def summary(gates: DataFrame) -> DataFrame:
    """Checks passed and in all; status pass only if all passed."""
    return gates.agg(F.count_if("passed").alias("passed"), F.count("*").alias("total"), F.when(F.bool_and("passed"), "pass").otherwise("fail").alias("status"))


def enforce(gates: DataFrame, most: int = 20) -> None:
    """Raises if a gate failed; the message names at most ``most`` of them."""
    failed = gates.filter(~F.col("passed")).limit(most).collect()
    if failed:
        raise ValueError("failed checks: " + ", ".join(f"{r['check']} ({r['value']} != {r['expected']})" for r in failed))
