"""The engine: one index under one folder, synced from files and queried by tools."""

from __future__ import annotations

import hashlib
import time
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..operators import catalog, chunking, filters, incremental, retrieval, runs, textindex


class EmbeddingProvider(Protocol):
    """Turns texts into vectors of a fixed width, some number at a time. ``name`` tells providers apart, with the width."""

    name: str
    dimensions: int
    max_batch_size: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashProvider:
    """Deterministic vectors from hashed words, for offline use."""

    def __init__(self, dimensions: int = 64, max_batch_size: int = 2048):
        self.name, self.dimensions, self.max_batch_size = "hash", dimensions, max_batch_size

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dimensions
            for w in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % self.dimensions] += 1.0 if h >> 63 else -1.0
            norm = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / norm for x in v])
        return out


class RetryingProvider:
    """Repeats a provider's failed requests up to three times, after the seconds that the error asks
    for (``retry_after``) or 1, 2 and 4 seconds. Other errors than ``OSError`` pass through."""

    def __init__(self, inner: EmbeddingProvider, retries: int = 3, wait: float = 1.0):
        self.inner, self.retries, self.wait = inner, retries, wait
        self.name, self.dimensions, self.max_batch_size = inner.name, inner.dimensions, inner.max_batch_size

    def embed(self, texts: list[str]) -> list[list[float]]:
        for n in range(self.retries + 1):
            try:
                return self.inner.embed(texts)
            except OSError as e:
                if n == self.retries:
                    raise
                time.sleep(getattr(e, "retry_after", None) or self.wait * 2**n)
        raise AssertionError


class Engine:
    """``sync`` brings files into the index; the other methods are its tools.

    Stored tables: ``chunks``, ``embeddings``, ``postings``, ``lengths`` and ``stats`` of the full-text
    index, ``manifest`` (files indexed), ``failed`` (files that could not be cut) and ``sources``.
    """

    KEYS = ["data_source_id", "file_path"]

    def __init__(self, spark: SparkSession, root: str, settings: model.Settings | None = None, provider: EmbeddingProvider | None = None):
        self.spark, self.settings = spark, settings or model.Settings()
        self.store = runs.Runs(spark, root)
        self.provider = provider or HashProvider(self.settings.dimensions)

    def _keys(self) -> dict:
        """What chunks and vectors were made with."""
        return {"cut": self.settings.cut_key(), "vectors": f"{self.provider.name}/{self.provider.dimensions}"}

    def sync(self, files: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, whole: bool = True, only: list[str] | None = None) -> DataFrame:
        """Files (``data_source_id, file_path, content, size``) become the index's content.

        Where ``whole`` is false, ``files`` are changes: only their paths are looked at, and one
        whose content is null is gone. With ``only``, ``files`` are all files of these sources, and other
        sources are left alone. Of a path that comes twice the last version by content counts.
        Only files that are new or changed are cut and embedded, and only sources with changes are
        written. Other limits of chunks than the index was made with cut all files anew; a set of
        changes is refused then, as it does not have them all. Another provider embeds all chunks
        anew (D11). A file that cannot be cut is listed in ``failed`` and tried again by the next
        sync. All tables become visible together, and not at all if another sync came in between.
        Returns the changes.
        """
        base, keys, made_with = self.store.current(), self.KEYS, self._keys()
        known = "chunks" in base["tables"] and base["meta"].get("cut") == made_with["cut"]
        if "chunks" in base["tables"] and not known and (not whole or only is not None):
            raise ValueError("files are cut by other limits than the index has: sync the whole of them first")
        files = files.withColumn("data_source_id", F.col("data_source_id").cast("string"))
        if only is not None:
            files = files.where(F.col("data_source_id").isin(only))
        files = files.groupBy(*keys).agg(F.max_by(F.struct("content", "size"), F.struct("content", "size")).alias("f")).select(*keys, "f.*")
        wanted = filters.eligible(filters.by_globs(files.where("content IS NOT NULL"), include or [], exclude or []))
        # The listing is written once: the changes, the manifest and the choice of files read it, not the contents.
        listed = self.store.write(base, "listing", wanted.select(*keys, "size", F.sha2("content", 256).alias("sha")))
        listing = self.store.read(listed)
        old = self.store.read(base["tables"]["manifest"]) if known else listing.where(F.lit(False))
        if only is not None:
            old = old.where(F.col("data_source_id").isin(only))
        if not whole:
            old = old.join(files.select(*keys), keys, "left_semi")
        compared = self.store.write(base, "changes", incremental.changes(old, listing))
        delta = self.store.read(compared)
        moved = delta.where("change != 'unchanged'")
        touched = [r[0] for r in moved.select("data_source_id").distinct().collect()]
        replaced = touched if known else None
        stale, come = moved.select(*keys), moved.where("change != 'deleted'").select(*keys)
        anew = known and base["meta"].get("vectors") != made_with["vectors"]
        tables = {}

        def laid(name: str, made: DataFrame, order: str | None = None) -> None:
            if known:
                before = self.store.read(base["tables"][name], touched).join(stale, keys, "left_anti")
                made = before.select(made.columns).unionByName(made)
            tables[name] = self.store.write(base, name, made, replaced, order)

        cut = self.store.write(base, "cut", chunking.chunk_files(wanted.join(come, keys, "left_semi"), self.settings.limits))
        rows = self.store.read(cut)
        made, wrong = rows.where("error IS NULL").drop("error"), rows.where("error IS NOT NULL")
        laid("chunks", made)
        if anew:
            every = incremental.with_vectors(self.store.read(tables["chunks"]), self.provider, keys)
            tables["embeddings"] = self.store.write(base, "embeddings", every)
        else:
            laid("embeddings", incremental.with_vectors(made, self.provider, keys))
        postings, lengths = textindex.build_index(made, carried=keys)
        laid("postings", postings, "term")
        laid("lengths", lengths)
        laid("manifest", listing.join(come, keys, "left_semi").join(wrong.select(*keys), keys, "left_anti"))
        laid("failed", wrong.select(*keys, "error"))
        held = self.store.read(tables["lengths"], replaced)
        stats = held.groupBy("data_source_id").agg(F.count("*").alias("rows"), F.sum("d").cast("long").alias("words"))
        tables["stats"] = self.store.write(base, "stats", stats, replaced)
        self.store.publish(base, tables, made_with, touched if known and not anew else None)
        for done in (listed, cut):
            self.store.drop(done)
        return delta

    def set_sources(self, sources: DataFrame) -> None:
        """The table of sources (``model.SOURCES``), which names repositories and their states."""
        base = self.store.current()
        self.store.publish(base, {"sources": self.store.write(base, "sources", sources)})

    def sources(self) -> DataFrame:
        tables = self.store.current()["tables"]
        return self.store.read(tables["sources"]) if "sources" in tables else self.spark.createDataFrame([], model.SOURCES)

    def chunks(self) -> DataFrame:
        return self.store.table("chunks")

    def chunks_by_id(self, ids: list[str]) -> DataFrame:
        """The chunks of these ids; row groups without them are passed over."""
        return self.chunks().where(F.col("chunk_id").isin(list(ids)))

    def chunk_ids(self, data_source_id: str, file_path: str | None = None) -> DataFrame:
        """Ids alone of a source's chunks, from its own folder, or of one of its files."""
        held = self.store.read(self.store.current()["tables"]["chunks"], [data_source_id])
        return (held if file_path is None else held.where(F.col("file_path") == file_path)).select("chunk_id")

    def in_scope(self, repository: str | None) -> list[str] | None:
        """ids of the sources that can be searched, by owner/repo, repo or id; None for all where no table names them."""
        known = self.sources()
        if not known.limit(1).count():
            return None if repository is None else [repository]
        ready = filters.searchable(known, self.store.table("stats").withColumnRenamed("rows", "chunks"))
        named = ready if repository is None else filters.in_repository(ready, repository).unionByName(ready.where(F.col("id") == repository))
        return sorted({r.id for r in named.select("id").collect()})

    def search(self, query: str, repository: str | None = None, cursor: str | None = None, page_size: float | None = None, mode: str = "hybrid") -> DataFrame:
        """One page of results, each with the cursor of the next page, if there is one.

        A cursor continues the same query and scope. Words and phrases are looked up in the stored
        postings; texts are read of the results alone. An index whose vectors another provider made is
        refused (F18).
        """
        base = self.store.current()
        if base["meta"].get("vectors") != self._keys()["vectors"]:
            raise ValueError("the vectors are another provider's: sync or rebuild them first")
        ids = self.in_scope(repository)
        scope_key = ",".join(ids or [])
        size, found = retrieval.page_size(page_size), retrieval.decode_cursor(cursor) if cursor else None
        if found and (found["query"] != query or found["scopeKey"] != scope_key):
            raise ValueError("the cursor belongs to another search")
        offset = int(found["offset"]) if found else 0
        tuning = model.Tuning()
        top_k = retrieval.fetch_size(self.settings.top_k, offset, size)
        scope = None if ids is None else F.col("data_source_id").isin(ids)
        tables = {name: self.store.read(base["tables"][name]) for name in ("chunks", "embeddings", "postings", "lengths", "stats")}
        near = tables["embeddings"].where(F.lit(True) if scope is None else scope).select("chunk_id", "embedding")
        stats = tables["stats"].agg(F.sum("rows").alias("rows"), (F.sum("words") / F.sum("rows")).alias("mean"))
        text = textindex.bm25_hits(tables["postings"], tables["lengths"], query, top_k * tuning.over_fetch, tuning.fts_path_weight, tuning.fts_content_weight, True, stats, scope)
        chunks = tables["chunks"] if scope is None else tables["chunks"].where(scope)
        hits = retrieval.search(chunks, near, query, self.provider.embed([query])[0], top_k, mode, tuning, None, True, text, True)
        page = retrieval.payload(hits, self.sources().select("id", "owner", "repo"), offset, size)
        return page.withColumn("next_cursor", F.when(F.col("has_more"), retrieval.encode_cursor(query, scope_key, offset + size)))

    def stats(self) -> DataFrame:
        return catalog.source_stats(self.chunks(), ["data_source_id"])

    def listing(self) -> DataFrame:
        """All sources with their statistics."""
        return catalog.source_listing(self.sources(), self.chunks())

    def due(self, schedule: str = "daily") -> DataFrame:
        """ST3: the sources that an hourly timer should sync now."""
        return filters.due(self.sources(), F.current_timestamp(), schedule)

    def file_tree(self, root: str = "", max_depth: int = 5, page: int = 1, page_size: int = 200) -> DataFrame:
        stats = catalog.file_stats(self.chunks())
        return catalog.page(catalog.tree_rows(stats, ["data_source_id"], root, max_depth=max_depth), ["data_source_id"], page, page_size)

    def workflows(self) -> DataFrame:
        return catalog.workflows(self.chunks())

    def actions(self) -> DataFrame:
        return catalog.actions(self.chunks())

    def readme(self, scope: str = "") -> DataFrame:
        return catalog.readme(catalog.first_chunks(self.chunks()), ["data_source_id"], scope)

    def rebuild_vectors(self) -> None:
        """All vectors anew, for a provider that has changed; chunks stay."""
        base = self.store.current()
        vectors = incremental.with_vectors(self.store.read(base["tables"]["chunks"]), self.provider, self.KEYS)
        self.store.publish(base, {"embeddings": self.store.write(base, "embeddings", vectors)}, {"vectors": self._keys()["vectors"]})

    def remove(self, data_source_id: str) -> None:
        """One source goes from all tables, all at once; nothing is rewritten."""
        base = self.store.current()
        tables = {k: t | {"parts": {s: p for s, p in t["parts"].items() if s != data_source_id}} for k, t in base["tables"].items() if k != "sources"}
        self.store.publish(base, tables)

    def clean(self, keep: int = 2) -> int:
        """Deletes the folders that none of the last ``keep`` syncs left in use."""
        return self.store.clean(keep)

    def files(self) -> DataFrame:
        """Files put together from their chunks, which may overlap or leave out lines."""
        return catalog.reassembled(self.chunks(), self.KEYS)
