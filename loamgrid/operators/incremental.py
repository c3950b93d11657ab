"""Keeping an index up to date: change sets, manifests and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranking import numbered


def changes(old: DataFrame, new: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """What became of each path between two listings (``sha`` tells versions apart).

    A renamed file is one deleted and one added path, so nothing of the old path stays.
    """
    keys = keys or ["data_source_id", "file_path"]
    a = old.select(*keys, F.col("sha").alias("old_sha"), F.lit(True).alias("_old"))
    b = new.select(*keys, F.col("sha").alias("new_sha"), F.lit(True).alias("_new"))
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted").when(F.col("old_sha") != F.col("new_sha"), "modified").otherwise("unchanged")
    return a.join(b, keys, "full").withColumn("change", kind).drop("_old", "_new")


def fetch_set(delta: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The paths to fetch, added and modified ones; a bag, so paths that come twice stay twice."""
    keys = keys or ["data_source_id", "file_path"]
    of = lambda kind: delta.where(F.col("change") == kind).select(*keys, "change")
    return of("added").unionByName(of("modified"))


def change_counts(delta: DataFrame, by: list[str]) -> DataFrame:
    """A20"""
    one = lambda kind: F.sum((F.col("change") == kind).cast("long")).alias(kind)
    return delta.groupBy(*by).agg(one("added"), one("modified"), one("deleted"), F.sum((F.col("change") != "unchanged").cast("long")).alias("total"))


def applied(rows: DataFrame, delta: DataFrame, fresh: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows of files that did not change, and the fresh rows of those that did."""
    keys = keys or ["data_source_id", "file_path"]
    gone = delta.where(F.col("change").isin("deleted", "modified")).select(*keys)
    return rows.join(gone, keys, "left_anti").unionByName(fresh)


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not among those to remove."""
    return rows.join(gone.select(*keys), keys, "left_anti")


def upserted(manifest: DataFrame, incoming: DataFrame) -> DataFrame:
    """``sha`` and ``size`` of a listed file change, its status stays; new files are pending."""
    keys = ["run_id", "file_path"]
    new = incoming.select(*keys, F.col("sha").alias("_sha"), F.col("size").alias("_size"))
    return manifest.join(new, keys, "full").select(
        *keys, F.coalesce("_sha", "sha").alias("sha"), F.coalesce("_size", "size").alias("size"), F.coalesce("status", F.lit("pending")).alias("status")
    )


def last_wins(meta: DataFrame) -> DataFrame:
    """Key-value rows with ``seq``; the latest of each key."""
    return meta.groupBy("key").agg(F.max_by("value", "seq").alias("value"))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Each key's row with the greatest ``order``. An aggregate, so a key with many rows is combined
    before the shuffle."""
    row = F.struct(*[c for c in rows.columns if c not in keys])
    return rows.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def reusable_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """The newest run of each key that is still running or has failed."""
    open_runs = runs.where(F.col("status").isin("running", "failed"))
    return latest(open_runs, keys, ["started_at", "seq"])


def folded(events: DataFrame, keys: list[str], fields: list[str], order: str = "seq") -> DataFrame:
    """The state that appended events lead to: of each field its last value that is not null."""
    return events.groupBy(*keys).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields])


def run_summary(files: DataFrame, by: list[str]) -> DataFrame:
    """Without ``by`` and rows, the first two sums are null and the last two are 0."""
    one = lambda status: F.sum(F.when(F.col("status") == status, 1).otherwise(0))
    return files.groupBy(*by).agg(
        one("completed").alias("completed"), one("failed").alias("failed"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens")
    )


def resumed(listing: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    """D03, D06, ST2: listed files that the run to resume has not completed in this version."""
    done = manifest.where("status = 'completed'").select(*keys, "sha")
    return listing.join(done, [*keys, "sha"], "left_anti")


#: The states a source may pass to from each state.
TRANSITIONS = {"pending": ["syncing", "deleting"], "syncing": ["ready", "error", "deleting"], "ready": ["syncing", "deleting"], "error": ["syncing", "deleting"], "deleting": ["error"]}


def lifecycle(events: DataFrame, keys: list[str], status: str = "status", order: str = "seq") -> DataFrame:
    """Each change of state with the one before it, and whether it is allowed."""
    before = F.coalesce(F.lag(status).over(Window.partitionBy(*keys).orderBy(order)), F.lit("pending"))
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, after in TRANSITIONS.items() for b in [*after, a]])
    rows = events.withColumn("before", before)
    return rows.withColumn("allowed", F.array_contains(allowed, F.concat_ws(">", "before", status)))


def pending(manifest: DataFrame) -> DataFrame:
    """Files of a run still to be done, by path."""
    return manifest.where("status != 'completed'").orderBy("file_path")


def run_key(commit: Column, include: Column, exclude: Column) -> Column:
    """Order of the patterns matters."""
    return F.sha2(F.to_json(F.struct(commit.alias("commit"), include.alias("include"), exclude.alias("exclude"))), 256)


def batches(rows: DataFrame, by: list[str], order: str, tokens: str = "tokens", first: int = 2048, most: int = 2048, most_tokens: int = 270_000) -> DataFrame:
    """Numbers each key's requests, from 1, in ``batch``.

    Rows are first cut into stretches of ``first`` (what a provider takes at most); within one, a
    request takes rows while it has at most ``most`` of them and ``most_tokens`` tokens, at least
    one. The fold goes over an array of one stretch, so its size is bounded.
    """
    # Numbered by counted ranges: a source with a third of all rows is not sorted by one task.
    cut = numbered(rows, by, [F.col(order)], "_place").withColumn("_stretch", F.floor((F.col("_place") - 1) / first)).drop("_place")
    row = F.struct(F.col(order).alias("_o"), F.col(tokens).cast("long").alias("_t"), F.struct(*rows.columns).alias("_row"))
    held = cut.groupBy(*by, "_stretch").agg(F.array_sort(F.collect_list(row)).alias("_rows"))

    def grown(state: Column, x: Column) -> Column:
        full = (state["n"] + 1 > most) | (state["t"] + x["_t"] > most_tokens)
        fresh = full & (state["n"] > 0)
        return F.struct(
            F.when(fresh, F.lit(1)).otherwise(state["n"] + 1).alias("n"),
            F.when(fresh, x["_t"]).otherwise(state["t"] + x["_t"]).alias("t"),
            F.when(fresh, state["k"] + 1).otherwise(state["k"]).alias("k"),
            F.concat(state["out"], F.array(F.when(fresh, state["k"] + 1).otherwise(state["k"]))).alias("out"),
        )

    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("t"), F.lit(1).alias("k"), F.array().cast("array<int>").alias("out"))
    folded_rows = held.withColumn("_k", F.aggregate("_rows", start, grown, lambda s: s["out"]))
    before = F.coalesce(F.sum(F.array_max("_k")).over(Window.partitionBy(*by).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pairs = folded_rows.withColumn("_before", before).select("_before", F.explode(F.arrays_zip("_rows", "_k")).alias("_x"))
    return pairs.select("_x._rows._row.*", (F.col("_before") + F.col("_x._k")).cast("long").alias("batch"))


def with_vectors(chunks: DataFrame, provider, carried: list[str] | None = None) -> DataFrame:
    """``chunk_id`` and ``embedding`` of each chunk from a provider, in Arrow batches, with the columns ``carried``."""
    import pandas as pd

    own = [*(carried or []), "chunk_id"]

    def run(held):
        for pdf in held:
            made = []
            for lo in range(0, len(pdf), provider.max_batch_size):
                made += provider.embed(pdf["content"].iloc[lo : lo + provider.max_batch_size].tolist())
            yield pd.DataFrame({**{c: pdf[c] for c in own}, "embedding": made})

    kinds = ", ".join(f"{c} {chunks.schema[c].dataType.simpleString()}" for c in own)
    return chunks.select(*own, "content").mapInPandas(run, f"{kinds}, embedding array<float>")
