"""A stored inverted index that searches read instead of the texts.

``postings`` are laid out by a hash of the term, so a query reads the files of its own terms and nothing else, whatever the size of the corpus;
each carries what ranking needs (length and time of its document).  The ``catalog`` holds the other columns, by a hash of the key.
An update writes a segment of its own with the fresh documents, and the keys that it replaces or removes as tombstones; what a
tombstone names in older segments is no longer seen.  A manifest lists the segments of a version of the index; it is claimed by creating its
file, which only one writer can do, so two writers never commit the same version: the later one gets :class:`Busy`, and readers keep the last
version committed.  Manifests of another format are not read; ``rebuild`` clears them.

Defined results: a document without words is in the catalog only; null texts count as empty; of a key that comes twice in one
update both rows are kept; an index that was never built holds nothing.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.text import GAP, LONG_TOKEN_BYTES, words
from threadloom.operators import search
from threadloom.plans import query as ql

FORMAT = 1
BUCKETS = 64
SPREAD = 2_000_000


class Busy(Exception):
    """Another writer committed first."""


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


class Index:
    """An index in a directory that all executors reach.  ``fields``: names of fields and the text columns they are made of."""

    def __init__(self, spark: SparkSession, directory: str, key: str = "doc_id", fields: dict[str, str] | None = None):
        self.spark, self.directory, self.key, self.fields = spark, directory, key, fields or {"content": "text"}

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return path(self.directory).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def manifest(self) -> dict:
        """{version, segments, n, total} of the last version committed; version 0 where there is none."""
        fs, path = self._fs()
        if fs.exists(path(self.directory)):
            for name in sorted((s.getPath().getName() for s in fs.listStatus(path(self.directory)) if s.getPath().getName().startswith(f"manifest-{FORMAT}-")), reverse=True):
                stream = fs.open(path(f"{self.directory}/{name}"))
                try:
                    return json.loads(bytes(stream.readAllBytes()))
                except ValueError:  # a writer is at it
                    continue
                finally:
                    stream.close()
        return {"version": 0, "segments": [], "n": 0, "total": {}}

    def _commit(self, manifest: dict) -> None:
        fs, path = self._fs()
        try:
            out = fs.create(path(f"{self.directory}/manifest-{FORMAT}-{manifest['version']:010d}"), False)
        except Exception as error:
            raise Busy(f"version {manifest['version']} is taken") from error
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()

    def rebuild(self, documents: DataFrame) -> dict:
        """A new index of the documents; older ones, of any format, are removed."""
        self.delete()
        return self.update(documents)

    def delete(self) -> None:
        fs, path = self._fs()
        fs.delete(path(self.directory), True)

    def update(self, fresh: DataFrame, gone: DataFrame | None = None) -> dict:
        """Commits a version in which ``fresh`` documents are added or replace those of their keys, and the keys of ``gone`` are removed."""
        before = self.manifest()
        name = f"segment-{before['version'] + 1:010d}-{uuid.uuid4().hex[:8]}"
        at = f"{self.directory}/{name}"
        timed = fresh if "modified_ts" in fresh.columns else fresh.withColumn("modified_ts", F.lit(0).cast("bigint"))
        made = search.entries(timed, self.key, self.fields, ("modified_ts",)).withColumn("bucket", bucket(F.col("term")))
        # A bucket is one file for each ``SPREAD`` documents: few files for few documents, and no task for all postings of a word.
        files = 1 + fresh.count() // SPREAD
        made.repartition(BUCKETS * files, "bucket", F.pmod(F.xxhash64(self.key), F.lit(files))).sortWithinPartitions("bucket", "field", "term").write.partitionBy("bucket").parquet(f"{at}/postings")
        lengths = {f: F.size(F.filter(words(F.col(c)), lambda w: F.octet_length(w) < LONG_TOKEN_BYTES)).cast("bigint").alias(f"len_{f}") for f, c in self.fields.items()}
        timed.select("*", *lengths.values()).drop(*set(self.fields.values())).write.parquet(f"{at}/catalog")
        keys = fresh.select(self.key) if gone is None else fresh.select(self.key).unionByName(gone.select(self.key))
        keys.distinct().write.parquet(f"{at}/tombstones")
        sums = [F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(f"len_{f}"), F.lit(0)).alias(f) for f in self.fields]]
        added = self.spark.read.parquet(f"{at}/catalog").agg(*sums).first().asDict()
        lost = dict.fromkeys(added, 0)
        if before["segments"]:
            lost = self.catalog(before).join(self.spark.read.parquet(f"{at}/tombstones"), self.key, "left_semi").agg(*sums).first().asDict()
        total = {f: before["total"].get(f, 0) + added[f] - lost[f] for f in self.fields}
        manifest = {"version": before["version"] + 1, "segments": [*before["segments"], name], "n": before["n"] + added["n"] - lost["n"], "total": total}
        self._commit(manifest)
        return manifest

    def _live(self, manifest: dict, table: str, only: Column | None = None) -> DataFrame:
        """The rows of a table in all segments, without those that a later segment's tombstones name."""
        out = None
        for k, name in enumerate(manifest["segments"]):
            rows = self.spark.read.parquet(f"{self.directory}/{name}/{table}")
            rows = rows if only is None else rows.where(only)
            later = manifest["segments"][k + 1 :]
            if later:
                rows = rows.join(self.spark.read.parquet(*[f"{self.directory}/{x}/tombstones" for x in later]).distinct(), self.key, "left_anti")
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out

    def catalog(self, manifest: dict | None = None) -> DataFrame:
        return self._live(manifest or self.manifest(), "catalog")

    def matching(self, text: str, defaults: tuple[str, ...] = ("content",)) -> DataFrame:
        """(key, score, modified_ts) of the documents that match, with their BM25 score.  Only the postings of the query's words are read; regular
        expressions, ranges and prefixes read the terms of all buckets, and a query that documents without any of its words match
        reads the catalog's keys too."""
        manifest = self.manifest()
        if not manifest["segments"]:
            return self.spark.createDataFrame([], f"{self.key} bigint, score double, modified_ts bigint")
        q = ql.parse(text, defaults)
        tree = ql.fold(q.tree)
        every, positive = ql.every_leaf(tree), ql.leaves(tree)
        exact = [x for x in positive if x.kind == "term" or x.kind == "phrase" and not x.slop and not x.prefix]
        boosts = [(x, x.boost) for x in exact]
        if q.bare:
            boosts += [(ql.Leaf("phrase", f, tuple(ql.analyze(q.text))), search.PHRASE_BOOST) for f in defaults]
        wanted = sorted({(x.field, w) for x in (*every, *(b for b, _ in boosts)) if x.kind in ("term", "phrase", "set") for w in x.values if w != GAP})
        wide = [x for x in every if x.kind in ("regex", "range") or x.prefix]
        of_terms = F.lit(False)
        if wanted:
            of_terms = F.struct("field", "term").isin(*[F.struct(F.lit(f).alias("field"), F.lit(w).alias("term")) for f, w in wanted])
            if not wide:  # the files of these terms only
                numbers = [r[0] for r in self.spark.createDataFrame([(w,) for _, w in wanted], "term string").select(bucket(F.col("term"))).distinct().collect()]
                of_terms = F.col("bucket").isin(*numbers) & F.col("term").isin(*sorted({w for _, w in wanted})) & of_terms
        for x in wide:
            test = F.col("term").startswith(x.values[-1]) if x.prefix else ql.word_condition(x)(F.col("term"))
            of_terms = of_terms | ((F.col("field") == x.field) & test)
        found = self._live(manifest, "postings", of_terms)
        df = {(r["field"], r["term"]): r["n"] for r in found.where(F.col("term").isin(*sorted({w for x, _ in boosts for w in x.values}))).groupBy("field", "term").agg(F.count(F.lit(1)).alias("n")).collect()} if boosts else {}
        # One row for each document: the postings of the query's words in it.
        rows = found.groupBy(self.key).agg(F.collect_list(F.struct("field", "term", "tf", "positions", "len")).alias("p"), F.max("modified_ts").alias("modified_ts"))
        if ql_true(tree):
            rows = self.catalog(manifest).select(self.key, "modified_ts").join(rows.drop("modified_ts"), self.key, "left").withColumn("p", F.coalesce("p", F.array().cast(rows.schema["p"].dataType)))
        score = F.lit(0.0)
        for leaf, boost in boosts:
            tf = self._count(leaf).cast("double")
            idf = sum(math.log(1 + (manifest["n"] - n + 0.5) / (n + 0.5)) for n in (df.get((leaf.field, w), 0) for w in leaf.values))
            length = F.coalesce(F.get(F.filter("p", lambda x: x["field"] == leaf.field), F.lit(0))["len"], F.lit(0))
            norm = search.K1 * (1 - search.B + search.B * length / F.lit((manifest["total"].get(leaf.field, 0) / max(1, manifest["n"])) or 1.0))
            score = score + F.when(tf > 0, boost * idf * tf * (search.K1 + 1) / (tf + norm)).otherwise(0.0)
        for leaf in positive:
            if leaf not in exact:
                score = score + F.when(self._holds(leaf), leaf.boost).otherwise(0.0)
        return rows.where(ql.condition(tree, self._holds)).select(self.key, score.alias("score"), "modified_ts")

    @staticmethod
    def _positions(leaf: ql.Leaf, k: int) -> Column:
        """Places of the phrase's word ``k`` in the document."""
        last = leaf.prefix and k == len(leaf.values) - 1
        one = F.filter("p", lambda x: (x["field"] == leaf.field) & (x["term"].startswith(leaf.values[k]) if last else x["term"] == leaf.values[k]))
        return F.flatten(F.transform(one, lambda x: x["positions"]))

    def _count(self, leaf: ql.Leaf) -> Column:
        if leaf.kind == "term":
            return F.coalesce(F.get(F.filter("p", lambda x: (x["field"] == leaf.field) & (x["term"] == leaf.values[0])), F.lit(0))["tf"], F.lit(0))
        starts = self._positions(leaf, 0)
        for k in range(1, len(leaf.values)):
            starts = F.array_intersect(starts, F.transform(self._positions(leaf, k), search._minus(k)))
        return F.size(starts)

    def _holds(self, leaf: ql.Leaf) -> Column:
        if leaf.kind == "phrase" and leaf.slop:
            ends = self._positions(leaf, 0)
            for k in range(1, len(leaf.values)):
                ends = F.filter(self._positions(leaf, k), _behind(ends, leaf.slop))
            forward = F.size(ends) > 0
            if len(leaf.values) == 2 and leaf.slop >= 2:
                return forward | F.exists(self._positions(leaf, 0), _behind(self._positions(leaf, 1), leaf.slop - 2))
            return forward
        if leaf.kind in ("term", "phrase"):
            return self._count(leaf) > 0
        test = ql.word_condition(leaf)
        return F.exists("p", lambda x: (x["field"] == leaf.field) & test(x["term"]))

    def search(self, request: search.Request, defaults: tuple[str, ...] = ("content",)) -> DataFrame:
        """The best ``limit`` documents with the columns of the catalog: the hits alone are joined with it."""
        hits = self.matching(request.query or "*", defaults)
        by_score = request.sort == "relevance" and request.query.strip()
        ranked = F.col("score") * search.recency(request.now) if by_score else F.col("modified_ts").cast("float")
        hits = hits.withColumn("score", ranked)
        f, plain = request.filters, search.Filters()
        limit, order = max(1, request.limit), [F.desc("score" if by_score else "modified_ts"), F.desc("modified_ts"), F.asc(self.key)]
        catalog = self.catalog().drop("modified_ts", *[f"len_{f}" for f in self.fields]) if self.manifest()["segments"] else None
        if catalog is None:
            return hits.limit(0)
        narrow = f != plain or request.scope is not None or any(c in catalog.columns for c in ("trashed", "superseded_by", "derivation_type"))
        if not narrow:
            return hits.orderBy(*order).limit(limit).join(catalog, self.key).orderBy(*order)
        c = search.filter_condition(f, catalog.columns)
        if request.scope is not None:
            c = c & search.scope_condition(request.scope, catalog.columns, request.case_sensitive_scope)
        return hits.join(catalog, self.key).where(c).orderBy(*order).limit(limit)


def _behind(places: Column, gap: int) -> Callable[[Column], Column]:
    """Whether a place comes after one of the places, with at most ``gap`` words between."""

    def after(p: Column) -> Callable[[Column], Column]:
        return lambda e: (p > e) & (p <= e + 1 + gap)

    return lambda p: F.exists(places, after(p))


def ql_true(tree) -> bool:
    """Whether a document that holds none of the query's words matches."""
    if isinstance(tree, bool):
        return tree
    if isinstance(tree, ql.Leaf):
        return False
    if tree.must and not all(ql_true(x) for x in tree.must):
        return False
    if not tree.must and tree.should and not any(ql_true(x) for x in tree.should):
        return False
    return not any(ql_true(x) for x in tree.must_not)
