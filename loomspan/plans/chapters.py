"""Books chapter by chapter: what is found in one chapter is known in the next, and nothing is asked twice.

A chapter may use the manual entries and those found in earlier chapters. Its *namespace* is a digest of the job and these entries, so a
published chapter is skipped for as long as they stay the same. When they change, targets of units that hold no changed entry are
inherited and only the others are asked again. Answers of a running chapter are committed round by round; targets, entries, the glossary used and the
log of a finished chapter are one commit.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomspan.functions import text as T
from loomspan.operators import cache, glossary, matching, review
from loomspan.operators.ranges import range_count
from loomspan.plans import jobs
from loomspan.sources.store import Store
from loomspan.storage import checkpointed, materialize, new_path, scratch, without_shuffles

TERMS = "ord long, term string, translation string, approved boolean, status string, source_chapter int"
TARGETS = "run_id string, unit_id string, fingerprint string, target string"
CACHE = "job string, run string, fingerprint string, target string, checksum string"
LOG = "chapter int, namespace string, seq int, status string, runs long, inherited long, terms long"

#: Takes a chapter and its rows ``unit_id, run_id, text, target``; gives ``term, translation`` or None.
Discover = Callable[[int, DataFrame], DataFrame | None]


class Unfinished(Exception):
    """Runs of a chapter are left without a target; what was answered is kept for the next attempt."""


class Chapters:
    """A job over ``chapter, book, unit_ord, unit_id, run_id, run_ord, text, context``, kept in ``store``."""

    def __init__(self, runs: DataFrame, call: jobs.BatchFunction, store: Store, job: str, discover: Discover, manual: DataFrame | None = None, verify=None, **limits) -> None:
        self.spark, self.store, self.job, self.call, self.discover, self.verify, self.limits = runs.sparkSession, store, job, call, discover, verify, limits
        # each chapter is read alone: the runs are dealt to chapters once
        path = new_path(self.spark)
        dealt = cache.fingerprints(runs.repartitionByRange(range_count(runs), "chapter", "unit_ord"))
        with without_shuffles(self.spark):
            dealt.write.option("compression", "zstd").partitionBy("chapter").parquet(path)
        self.runs = self.spark.read.schema(dealt.schema).parquet(path)
        self.numbers = sorted(r["chapter"] for r in self.runs.select("chapter").distinct().collect())  # one number per chapter of a book
        none = self.spark.createDataFrame([], TERMS)
        self.manual = none if manual is None else manual.select("ord", "term", "translation", F.lit(True).alias("approved"), F.lit("verified").alias("status"), F.lit(None).cast("int").alias("source_chapter"))

    # ---- what a chapter knows ----

    def known(self, n: int) -> DataFrame:
        """``chapter, ord, term, translation, source_chapter``: entries that chapter ``n`` may use."""
        found = self.store.read("terms", TERMS, "chapters")
        one = self.spark.range(1).select(F.lit(n).alias("chapter"))
        return checkpointed(glossary.as_of(one, glossary.manual_wins(found, self.manual)))

    def _log(self) -> DataFrame:
        return self.store.read("log", LOG, "chapters")

    def _inherited(self, n: int, own: DataFrame, known: DataFrame, namespace: str) -> DataFrame:
        """Cache rows for the targets of the chapter's last version that no changed entry touches."""
        last = self._log().where(F.col("chapter") == n).orderBy(F.desc("seq")).limit(1).collect()
        if not last:
            return self.spark.createDataFrame([], CACHE)
        name = _name(n, last[0]["namespace"])
        both = "ord long, term string, translation string, approved boolean"
        old = self.store.read("glossary", both, "chapters", name)
        changed = glossary.difference(old, known.select("ord", "term", "translation", F.lit(True).alias("approved"))).select("term").distinct()
        texts = own.groupBy("unit_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run_ord", "text"))), lambda r: r["text"]), " ").alias("text"))
        kept, _ = matching.inheritance(self.store.read("targets", TARGETS, "chapters", name), own.select("run_id", "unit_id"), matching.affected_units(texts, changed))
        return kept.select(F.lit(namespace).alias("job"), F.col("run_id").alias("run"), "fingerprint", "target", T.digest("target").alias("checksum"))

    # ---- one chapter ----

    def chapter(self, n: int) -> bool:
        """Publish chapter ``n``; False if it is published with the same entries. What it wrote on the way goes."""
        with scratch(self.spark):
            return self._published(n)

    def _published(self, n: int) -> bool:
        known = self.known(n)
        namespace = cache.namespaces(known.sparkSession.range(1).select(F.lit(n).alias("chapter")), self.job, known).first()["namespace"]
        published = self.store.names("chapters")
        if _name(n, namespace) in published:
            return False
        first = not any(x.startswith(f"{n:08d}-") for x in published)
        own = self.runs.where(F.col("chapter") == n)
        rounds = self.store.read("cache", CACHE, f"rounds-{namespace}")
        before = materialize(self._inherited(n, own, known, namespace).join(rounds.select("run"), "run", "left_anti").select(*rounds.columns))

        def commit(rows: DataFrame) -> None:
            self.store.commit(f"rounds-{namespace}", uuid.uuid4().hex, cache=rows)

        done, _ = jobs.answered(own.drop("chapter"), self.call, namespace, rounds.unionByName(before), glossary=known.select("term", "translation"), commit=commit, **self.limits)
        missing = cache.coverage(own, done).count()
        if missing:
            raise Unfinished(f"chapter {n}: {missing} runs have no target")
        terms = self._found(n, own.select("unit_id", "run_id", "text").join(done.select("run_id", "target"), "run_id")) if first else self.spark.createDataFrame([], TERMS)
        terms = materialize(terms)
        log = self.spark.createDataFrame([(n, namespace, len(published), "published", done.count(), before.count(), terms.count())], LOG)
        fresh = self.store.commit("chapters", _name(n, namespace), targets=done.select("run_id", "unit_id", "fingerprint", "target"), terms=terms, glossary=known.select("ord", "term", "translation", F.lit(True).alias("approved")), log=log)
        self.store.drop(f"rounds-{namespace}")  # its answers are in the commit
        return fresh

    def _found(self, n: int, targets: DataFrame) -> DataFrame:
        """The entries that chapter ``n`` adds: those discovered and, with a verifier, judged ``verified``."""
        found = self.discover(n, targets.select("unit_id", "run_id", "text", "target"))
        if found is None:
            return self.spark.createDataFrame([], TERMS)
        fresh = found.select("term", "translation")
        if self.verify is not None:
            asked = fresh.select(F.xxhash64("term").alias("ord"), F.lit(n).alias("chapter"), F.col("term").alias("source_term"), "translation")
            judged = checkpointed(review.verified(asked, self.verify)).where("verdict = 'verified'").select(F.col("source_term").alias("term"), "corrected")
            fresh = fresh.join(judged, "term").select("term", F.coalesce(F.nullif("corrected", F.lit("")), "translation").alias("translation"))
        # an entry of an earlier chapter comes before one of a later chapter
        order = F.lit(n).cast("long") * (1 << 40) + F.pmod(F.xxhash64("term", "translation"), F.lit(1 << 40))
        return fresh.select(order.alias("ord"), "term", "translation", F.lit(True).alias("approved"), F.lit("verified").alias("status"), F.lit(n).cast("int").alias("source_chapter"))

    # ---- many ----

    def publish(self, upto: int | None = None) -> list[int]:
        """Publish all chapters up to ``upto`` (all of them) in order, those that are published excepted; gives the numbers of the others."""
        return [n for n in self.numbers if (upto is None or n <= upto) and self.chapter(n)]

    def follow(self, announced: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Publish as chapters are announced by a stream ``chapter``. A micro-batch publishes all chapters up to its largest, in order; run again
        after a crash it finds them published, so it neither loses nor doubles any."""

        def batch(rows: DataFrame, _: int) -> None:
            upto = rows.agg(F.max("chapter")).first()[0]
            if upto is not None:
                self.publish(upto)

        writer = announced.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()

    def targets(self) -> DataFrame:
        """``chapter, run_id, unit_id, target``: the newest version of every published chapter."""
        newest: dict[int, tuple[int, str]] = {}
        for r in self._log().collect():  # one row per version of a chapter
            newest[r["chapter"]] = max(newest.get(r["chapter"], (-1, "")), (r["seq"], r["namespace"]))
        out = self.spark.createDataFrame([], "chapter int, run_id string, unit_id string, target string")
        for n, (_, namespace) in sorted(newest.items()):
            own = self.store.read("targets", TARGETS, "chapters", _name(n, namespace))
            out = out.unionByName(own.select(F.lit(n).alias("chapter"), "run_id", "unit_id", "target"))
        return out


def _name(n: int, namespace: str) -> str:
    return f"{n:08d}-{namespace}"


def job_store(spark: SparkSession) -> Store:
    """A store among this application's tables, for jobs that need not outlive it."""
    return Store(spark, new_path(spark))
