"""The trigram index: tables in a folder, built and read with Spark.

    manifests/N.json   version, mode, built_at, the layers that count, and the last batch applied of each stream
    layers/NAME/       files      file_id, path, layer, deleted
                       trigrams   trigram, df, layer
                       postings   trigram, segment, layer, n, file_ids (ascending)

A posting list is cut into segments of file ids, so that no row and no task ever holds the list of a frequent trigram as a
whole, and lists are intersected segment by segment. Postings are sorted by trigram within files: a look-up reads the pages
whose range holds one of a few numbers. Changes add a layer; the last layer of a file counts, and compact() makes one of all.

A layer is written to a folder of its own and counts once a manifest names it. Manifests are only added: the last one holds,
a reader stays with the one it began with, and whatever a writer that died left behind is named by none.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramforge.functions import trigrams as T
from gramforge.functions.ignore import ALWAYS, Rules, kept
from gramforge.operators.scan import texts_of

VERSION = 4
SEGMENT_BITS = 16
SCHEMAS = {
    "files": "file_id long, path string, layer int, deleted boolean",
    "trigrams": "trigram int, df long, layer int",
    "postings": "trigram int, segment long, layer int, n int, file_ids array<long>",
}


class IndexMismatch(ValueError):
    """The folder holds no index, or one of another version."""


def pairs(corpus: DataFrame, everything: bool = False, only: list[int] | None = None) -> DataFrame:
    """Distinct (trigram, file_id) of a corpus; only: of these trigrams, which are picked where they are made. They are
    distinct within a text already, so nothing is shuffled for it."""
    return T.with_trigrams(texts_of(corpus), everything, only).select("file_id", F.explode("trigrams").alias("trigram"))


def _whole(partial: DataFrame) -> DataFrame:
    ids = F.array_sort(F.array_distinct(F.flatten(F.collect_list("file_ids"))))
    return partial.groupBy("trigram", "segment").agg(ids.alias("file_ids"))


def posting_lists(corpus: DataFrame, everything: bool = False) -> DataFrame:
    """trigram, segment and file_ids of a corpus. One shuffle, of lists that each task has begun."""
    return _whole(T.partial_lists(texts_of(corpus), SEGMENT_BITS, everything))


def lists_of(pairs_: DataFrame) -> DataFrame:
    """posting_lists() from pairs."""
    segment = F.shiftright("file_id", SEGMENT_BITS).cast("long").alias("segment")
    return _whole(pairs_.select("trigram", segment, F.array("file_id").alias("file_ids")))


def frequencies(pairs_: DataFrame) -> DataFrame:
    return pairs_.groupBy("trigram").agg(F.count("*").alias("df"))


@dataclass(frozen=True)
class Plan:
    """What the driver decides from a pattern and the document frequencies of its trigrams."""

    required: list[int]  # trigrams to look up; empty: every file is a candidate
    nothing: bool = False  # a trigram is missing, so nothing can match
    most: int | None = None  # candidates there are at most, where trigrams are required

    @staticmethod
    def asked(pattern: bytes) -> list[int]:
        """Of more than MAX_TRIGRAMS distinct trigrams, those of brackets and blanks alone aren't asked for, unless all are
        such."""
        own = T.of_pattern(pattern)
        return ([t for t in own if not T.is_noise(t)] or own) if len(own) > T.MAX_TRIGRAMS else own

    @staticmethod
    def of(pattern: bytes, df: dict[int, int]) -> Plan:
        """The rarest MAX_TRIGRAMS of those asked for are taken, equal ones by number."""
        own = Plan.asked(pattern)
        if not own:
            return Plan([])
        if any(t not in df for t in own):
            return Plan(own, nothing=True)
        own = sorted(own, key=lambda t: (df[t], t))[: T.MAX_TRIGRAMS]
        return Plan(own, most=df[own[0]])


def intersect(postings: DataFrame, required: list[int]) -> DataFrame:
    """file_id (and layer, where the lists have one) of the files that are in the lists of all the required trigrams."""
    keys = [c for c in ("layer", "segment") if c in postings.columns]
    lists = postings.filter(F.col("trigram").isin(required))
    met = lists.groupBy(*keys).agg(F.count("*").alias("_n"), F.collect_list("file_ids").alias("_l")).filter(F.col("_n") == len(required))
    both = F.aggregate(F.slice("_l", 2, len(required)), F.get("_l", F.lit(0)), F.array_intersect)
    return met.select(*keys, F.explode(both).alias("file_id")).drop("segment")


@dataclass(frozen=True)
class Manifest:
    """A state of an index: layer numbers and their folders, and the last batch of each stream that is in it."""

    number: int
    mode: str
    layers: dict[int, str]
    batches: dict[str, int] = field(default_factory=dict)


class TrigramIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # -- writing

    @classmethod
    def build(cls, corpus: DataFrame, path: str, mode: str = "compat", if_exists: str = "overwrite", rules: tuple[str, ...] = ()) -> TrigramIndex:
        """corpus: file_id, path, content. mode compat holds lines of 3 to 512 bytes with an ASCII letter or digit, as they
        are; lossless holds all lines in ASCII lower case, which makes indexed searches equal to scans, with and without
        regard to case. if_exists: overwrite or error. Files that the rules ignore, and those in ALWAYS, stay out."""
        if mode not in ("compat", "lossless"):
            raise ValueError(f"unknown mode {mode}")
        own = cls(corpus.sparkSession, path)
        if if_exists == "error" and own.exists():
            raise FileExistsError(path)
        corpus = corpus.filter(kept(F.col("path"), Rules.of((*rules, *ALWAYS))))
        folder = own._write_layer(corpus, mode, 0)
        own._publish(Manifest(own._last_number(), mode, {0: folder}))
        own.vacuum()
        return own

    def _write_layer(self, corpus: DataFrame, mode: str, layer: int, deleted: DataFrame | None = None) -> str:
        corpus = corpus.select(F.col("file_id").cast("long").alias("file_id"), "path", "content")
        files = corpus.groupBy("file_id").agg(F.max("path").alias("path")).withColumn("deleted", F.lit(False))
        if deleted is not None:
            files = files.unionByName(deleted.select(F.col("file_id").cast("long").alias("file_id"), F.lit(None).cast("string").alias("path"), F.lit(True).alias("deleted")))
        return self._write_tables(files, posting_lists(corpus, everything=mode == "lossless"), layer)

    def _write_tables(self, files: DataFrame, lists: DataFrame, layer: int) -> str:
        """The tables of a layer in a new folder. Document frequencies are summed up from the lengths of the lists written."""
        folder = f"layers/{uuid.uuid4().hex}"
        put = lambda df, name: df.withColumn("layer", F.lit(layer)).select(*(c.split()[0] for c in SCHEMAS[name].split(", "))).write.parquet(f"{self.path}/{folder}/{name}")
        put(lists.withColumn("n", F.size("file_ids")).sortWithinPartitions("trigram", "segment"), "postings")
        written = self.spark.read.schema(SCHEMAS["postings"]).parquet(f"{self.path}/{folder}/postings")
        put(written.groupBy("trigram").agg(F.sum("n").cast("long").alias("df")).sortWithinPartitions("trigram"), "trigrams")
        put(files, "files")
        return folder

    def apply(self, changed: DataFrame | None, deleted: DataFrame | None = None, batch: tuple[str, int] | None = None) -> int:
        """Adds a layer: changed (file_id, path, content) replaces or adds files, deleted (file_id) removes them. Returns
        its number. batch: a stream and the number of its batch; one that is in the index already isn't applied again."""
        now = self.manifest()
        if batch is not None and now.batches.get(batch[0], -1) >= batch[1]:
            return max(now.layers)
        layer = max(now.layers) + 1
        corpus = changed if changed is not None else self.spark.createDataFrame([], "file_id long, path string, content string")
        folder = self._write_layer(corpus, now.mode, layer, deleted)
        self._publish(replace(now, layers=now.layers | {layer: folder}, batches=now.batches | ({batch[0]: batch[1]} if batch else {})))
        return layer

    def compact(self) -> None:
        """One layer of all, which counts once it is written as a whole; then what the last two states don't name goes."""
        now = self.manifest()
        live = self.live(now)
        folder = self._write_tables(live.select("file_id", "path").withColumn("deleted", F.lit(False)), lists_of(self.live_pairs(now)), 0)
        self._publish(replace(now, layers={0: folder}))
        self.vacuum()

    def vacuum(self, states: int = 2) -> None:
        """Drops all but the last `states` manifests, and the layers that none of these names."""
        fs, at = self._fs()
        numbers = self._numbers()
        named = {f for n in numbers[-states:] if (m := self._read(n)) for f in m["layers"].values()}
        for status in fs.listStatus(at(f"{self.path}/layers")):
            if f"layers/{status.getPath().getName()}" not in named:
                fs.delete(status.getPath(), True)
        for n in numbers[:-states]:
            fs.delete(at(f"{self.path}/manifests/{n:08d}.json"), False)

    # -- manifests

    def _fs(self):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _numbers(self) -> list[int]:
        fs, at = self._fs()
        folder = at(f"{self.path}/manifests")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _last_number(self) -> int:
        return max(self._numbers(), default=-1)

    def _read(self, number: int) -> dict | None:
        fs, at = self._fs()
        stream = fs.open(at(f"{self.path}/manifests/{number:08d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, state: Manifest) -> None:
        """The next manifest, by a rename: it is there as a whole or not at all."""
        fs, at = self._fs()
        number = state.number + 1
        body = {"version": VERSION, "mode": state.mode, "built_at": int(time.time()), "layers": {str(k): v for k, v in state.layers.items()}, "batches": state.batches}
        draft, final = at(f"{self.path}/manifests/.{uuid.uuid4().hex}"), at(f"{self.path}/manifests/{number:08d}.json")
        out = fs.create(draft, False)
        out.writeBytes(json.dumps(body))
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise FileExistsError(f"another writer has changed the index in {self.path}")

    def manifest(self) -> Manifest:
        numbers = self._numbers()
        if not numbers:
            raise IndexMismatch(f"no index in {self.path}")
        own = self._read(numbers[-1])
        if own.get("version") != VERSION:
            raise IndexMismatch(f"the index in {self.path} has another version")
        return Manifest(numbers[-1], own["mode"], {int(k): v for k, v in own["layers"].items()}, own["batches"])

    # -- reading

    def exists(self) -> bool:
        return bool(self._numbers())

    def table(self, name: str, state: Manifest | None = None) -> DataFrame:
        state = state or self.manifest()
        return self.spark.read.schema(SCHEMAS[name]).parquet(*(f"{self.path}/{f}/{name}" for f in state.layers.values()))

    def mode(self) -> str:
        return self.manifest().mode

    def live(self, state: Manifest | None = None) -> DataFrame:
        """file_id, path and layer of the files as of the last layer of each."""
        state = state or self.manifest()
        files = self.table("files", state)
        if len(state.layers) > 1:
            files = files.groupBy("file_id").agg(F.max(F.struct("layer", "deleted", "path")).alias("_f")).select("file_id", "_f.*")
        return files.filter("not deleted").select("file_id", "path", "layer")

    def plan(self, literal: str, state: Manifest | None = None) -> Plan:
        """A small job: of one table, the rows of the literal's trigrams. Summed over layers they count replaced and deleted
        files too, so where some trigrams have to be picked among more, the files that are left are counted in the lists."""
        state = state or self.manifest()
        data = literal.encode().lower() if state.mode == "lossless" else literal.encode()
        own = Plan.asked(data)
        df: dict[int, int] = {}
        # a row for each of the literal's trigrams and each layer
        for r in self.table("trigrams", state).filter(F.col("trigram").isin(own)).select("trigram", "df").collect() if own else []:
            df[r["trigram"]] = df.get(r["trigram"], 0) + r["df"]
        if len(state.layers) > 1 and len(own) > T.MAX_TRIGRAMS and len(df) == len(own):
            df = {r["trigram"]: r["df"] for r in frequencies(self.live_pairs(state, own)).collect()}
        return Plan.of(data, df)

    def live_pairs(self, state: Manifest, own: list[int] | None = None) -> DataFrame:
        """trigram and file_id as of the last layer of each file; own: of these trigrams alone."""
        lists = self.table("postings", state)
        lists = lists if own is None else lists.filter(F.col("trigram").isin(own))
        each = lists.select("trigram", "layer", F.explode("file_ids").alias("file_id"))
        return each.join(self.live(state).select("file_id", "layer"), ["file_id", "layer"], "left_semi").select("trigram", "file_id")

    def candidate_ids(self, plan: Plan, state: Manifest) -> DataFrame:
        """file_id (and layer) of the files that a plan leaves; what a later layer replaced or deleted is not among them."""
        found = intersect(self.table("postings", state), plan.required)
        return found if len(state.layers) == 1 else self.live(state).join(found, ["file_id", "layer"], "left_semi").select("file_id", "layer")

    def candidates(self, literal: str, plan: Plan | None = None, state: Manifest | None = None) -> DataFrame:
        """file_id and path of the files that may hold the literal, as far as the index knows."""
        state = state or self.manifest()
        plan = plan or self.plan(literal, state)
        live = self.live(state)
        if plan.nothing:
            return live.select("file_id", "path").limit(0)
        if not plan.required:
            return live.select("file_id", "path")
        return live.join(self.candidate_ids(plan, state).select("file_id"), "file_id", "left_semi").select("file_id", "path")

    def stats(self) -> DataFrame:
        """pairs, trigrams and longest_list; raw_bytes (four for each pair), delta_bytes (of the differences of neighbours,
        seven bits a byte) and their ratio."""
        deltas = F.transform(F.col("file_ids"), lambda x, i: F.when(i == 0, x).otherwise(x - F.get("file_ids", i - 1)))
        width = lambda d: F.greatest(F.lit(1), F.ceil(F.length(F.bin(d)) / 7)).cast("long")
        lists = self.table("postings").withColumn("_d", F.aggregate(F.transform(deltas, width), F.lit(0).cast("long"), lambda a, b: a + b))
        out = lists.agg(F.sum("n").cast("long").alias("pairs"), F.countDistinct("trigram").alias("trigrams"), F.max("n").alias("longest_list"), F.sum("_d").alias("delta_bytes"))
        return out.select("pairs", "trigrams", "longest_list", (F.col("pairs") * 4).alias("raw_bytes"), "delta_bytes", (F.col("delta_bytes") / (F.col("pairs") * 4)).alias("ratio"))
