"""The score store: row data, traits and groups below one folder, changed by commits.

``rows/commit=<id>`` holds one row per variant or gene in order (ordinal, keys,
jackknife_blocks), ``traits/trait=<name>/commit=<id>`` a trait's scores by ordinal; files
are written once and never changed.  ``manifest/<n>.json`` is the n-th state: which rows,
traits, parameters and groups there are.  A change writes its data first and then the
next manifest, under a number that must be free.  So a reader always sees one whole
state, a writer that is lost leaves the last one, and of two writers at once one fails.
Traits are folders, so reading some of them leaves the rest alone.
"""

from __future__ import annotations

import fnmatch
import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ConcurrentCommit(RuntimeError):
    """Another writer has committed since this one read the store."""


class _Folder:
    """Small files of one folder, through Spark's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self._sc = spark.sparkContext
        self._fs = self._sc._jvm.org.apache.hadoop.fs
        self.path = path
        self._system = self._fs.Path(path).getFileSystem(self._sc._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        at = self._fs.Path(self.path)
        return sorted(s.getPath().getName() for s in self._system.listStatus(at)) if self._system.exists(at) else []

    def read(self, name: str) -> str:
        stream = self._system.open(self._fs.Path(f"{self.path}/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def add(self, name: str, text: str) -> None:
        """Makes a file that must not be there yet; it appears whole."""
        draft = self._fs.Path(f"{self.path}/.{uuid.uuid4().hex}")
        stream = self._system.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        rename = getattr(self._sc._jvm.org.apache.hadoop.fs, "Options$Rename")
        none = self._sc._gateway.new_array(rename, 0)
        context = self._fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else self._system.getUri(), self._sc._jsc.hadoopConfiguration())
        try:
            context.rename(draft, self._fs.Path(f"{self.path}/{name}"), none)
        except Exception as e:
            self._system.delete(draft, False)
            if "AlreadyExists" in str(e):
                raise FileExistsError(name) from e
            raise

    def drop(self, name: str) -> None:
        self._system.delete(self._fs.Path(f"{self.path}/{name}"), True)


class ScoreStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._manifests = _Folder(spark, f"{self.path}/manifest")

    def _latest(self) -> tuple[int, dict]:
        """(number, state) of the last commit; 0 and nothing where there is no store."""
        names = [n for n in self._manifests.names() if n.endswith(".json") and not n.startswith(".")]
        return (int(names[-1][:-5]), json.loads(self._manifests.read(names[-1]))) if names else (0, {})

    def _state(self) -> dict:
        number, state = self._latest()
        if not number:
            raise FileNotFoundError(f"no store at {self.path}")
        return state

    def _commit(self, after: int, state: dict) -> None:
        try:
            self._manifests.add(f"{after + 1:08d}.json", json.dumps(state, sort_keys=True))
        except FileExistsError as e:
            raise ConcurrentCommit(f"{self.path} has changed since it was read") from e

    def create(self, rows: DataFrame, kind: str, keys: list[str]) -> None:
        if not {"ordinal", "jackknife_blocks", *keys} <= set(rows.columns):
            raise ValueError("rows need ordinal, jackknife_blocks and the merge keys")
        if self._latest()[0]:
            raise FileExistsError(f"there is a store at {self.path}")
        place = f"rows/commit={uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{place}")
        self._commit(0, {"rows": place, "kind": kind, "keys": keys, "traits": {}, "parameters": {}, "groups": {}})

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self._state()['rows']}")

    def meta(self) -> tuple[str, list[str]]:
        state = self._state()
        return state["kind"], state["keys"]

    def validate_rows(self, rows: DataFrame) -> None:
        """Raises unless ``rows`` equal the stored ones in every shared key column."""
        mine = self.rows()
        columns = ["ordinal", "jackknife_blocks", *self.meta()[1]]
        a, b = mine.select(*columns), rows.select(*columns)
        if not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty():
            raise ValueError("the rows differ from those of the store")

    def replace_rows(self, rows: DataFrame, kind: str, keys: list[str]) -> None:
        """Other rows, in one commit; the traits and groups of the old ones go with them."""
        number, _ = self._latest()
        place = f"rows/commit={uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{place}")
        self._commit(number, {"rows": place, "kind": kind, "keys": keys, "traits": {}, "parameters": {}, "groups": {}})

    def traits(self) -> list[str]:
        return sorted(self._latest()[1].get("traits", {}))

    def write_trait(self, trait: str, scores: DataFrame, overwrite: bool = False, parameters: tuple[list[str], list[float]] | None = None) -> None:
        """``scores``: ordinal, gradient and any more columns; and the model's parameters."""
        name, (number, state) = self._name(trait), self._latest()
        if not number:
            raise FileNotFoundError(f"no store at {self.path}")
        if name in state["traits"] and not overwrite:
            raise FileExistsError(f"trait {name} is in the store")
        place = f"trait={name}/commit={uuid.uuid4().hex}"
        scores.write.parquet(f"{self.path}/traits/{place}")
        state["traits"][name] = place
        state["parameters"].pop(name, None)
        if parameters is not None:
            state["parameters"][name] = [[n, float(v)] for n, v in zip(*parameters, strict=True)]
        self._commit(number, state)

    @staticmethod
    def _name(name: str) -> str:
        name = name.replace("/", "_")
        if not name or any(c in name for c in "\\=") or name.startswith((".", "_")):
            raise ValueError(f"{name!r} can't be the name of a trait")
        return name

    def write_parameters(self, trait: str, names: list[str], values: list[float]) -> None:
        """A model's parameters beside a trait's scores."""
        number, state = self._latest()
        if self._name(trait) not in state.get("traits", {}):
            raise KeyError(trait)
        state["parameters"][self._name(trait)] = [[n, float(v)] for n, v in zip(names, values, strict=True)]
        self._commit(number, state)

    def parameters(self, trait: str) -> DataFrame | None:
        found = self._state()["parameters"].get(trait)
        return None if found is None else self.spark.createDataFrame([(k, n, v) for k, (n, v) in enumerate(found)], "place int, name string, value double").orderBy("place")

    def load_trait(self, trait: str) -> DataFrame:
        """Row data with the trait's scores beside them."""
        return self.load_traits([trait]).drop("trait")

    def load_traits(self, traits: list[str]) -> DataFrame:
        """Row data with the scores of several traits beside them, a row per trait; all of one state."""
        state = self._state()
        if gone := sorted(set(traits) - set(state["traits"])):
            raise KeyError(gone[0] if len(gone) == 1 else gone)
        places = {state["traits"][t]: t for t in traits}
        found = self.spark.read.option("basePath", f"{self.path}/traits").option("mergeSchema", "true").parquet(*[f"{self.path}/traits/{p}" for p in places])
        names = F.create_map(*[F.lit(x) for p, t in places.items() for x in (p.split("commit=")[1], t)])
        rows = self.spark.read.parquet(f"{self.path}/{state['rows']}")
        return rows.join(found.withColumn("trait", names[F.col("commit").cast("string")]).drop("commit"), "ordinal")

    def groups(self) -> dict[str, list[str]]:
        return {g: sorted(ts) for g, ts in self._latest()[1].get("groups", {}).items()}

    def write_groups(self, groups: dict[str, list[str]]) -> None:
        number, state = self._latest()
        self._commit(number, {**state, "groups": groups})

    def add_group(self, group: str, patterns: list[str]) -> list[str]:
        """A group of the traits that match any glob; two at least, the name unused."""
        number, state = self._latest()
        known = sorted(state.get("traits", {}))
        found = [t for t in known if any(fnmatch.fnmatch(t, p) for p in patterns)]
        if group in known or group in state.get("groups", {}):
            raise ValueError(f"{group} is in use")
        if len(found) < 2:
            raise ValueError("a group needs two traits")
        self._commit(number, {**state, "groups": {**state["groups"], group: found}})
        return found

    def names(self, name: str | None = None) -> list[str]:
        """A trait, a group's traits, or all."""
        if name is None:
            return self.traits()
        return self.groups().get(name) or ([name] if name in self.traits() else [])

    def remove(self, pattern: str) -> list[str]:
        """Traits or groups by exact name, else by glob; groups left with one trait go.  The
        files stay for readers of the state before, until ``vacuum``."""
        number, state = self._latest()
        every = [*sorted(state.get("traits", {})), *state.get("groups", {})]
        hit = [x for x in every if x == pattern] or [x for x in every if fnmatch.fnmatch(x, pattern)]
        if not hit:
            raise KeyError(pattern)
        left = {g: [t for t in ts if t not in hit] for g, ts in state["groups"].items() if g not in hit}
        kept = {k: {t: x for t, x in state[k].items() if t not in hit} for k in ("traits", "parameters")}
        self._commit(number, {**state, **kept, "groups": {g: ts for g, ts in left.items() if len(ts) > 1}})
        return hit

    def rename(self, old: str, new: str) -> None:
        number, state = self._latest()
        traits, groups = state.get("traits", {}), state.get("groups", {})
        if new in traits or new in groups:
            raise ValueError(f"{new} is in use")
        if old in traits:
            new = self._name(new)
            kept = {k: {new if t == old else t: x for t, x in state[k].items()} for k in ("traits", "parameters")}
            self._commit(number, {**state, **kept, "groups": {g: [new if t == old else t for t in ts] for g, ts in groups.items()}})
        elif old in groups:
            self._commit(number, {**state, "groups": {new if g == old else g: ts for g, ts in groups.items()}})
        else:
            raise KeyError(old)

    def vacuum(self) -> list[str]:
        """Deletes data that the last state doesn't name, and older manifests; only while no
        one writes, and no one reads an older state."""
        number, state = self._latest()
        used = {state["rows"].split("/")[1], *(p.split("/")[1] for p in state["traits"].values())}
        gone = []
        for top in ["rows", *[f"traits/{n}" for n in _Folder(self.spark, f"{self.path}/traits").names()]]:
            folder = _Folder(self.spark, f"{self.path}/{top}")
            for name in folder.names():
                if name.startswith("commit=") and name not in used:
                    folder.drop(name)
                    gone.append(f"{top}/{name}")
        for name in self._manifests.names():
            if name != f"{number:08d}.json":
                self._manifests.drop(name)
        return gone


def block_fingerprints(variants: DataFrame, blocks: DataFrame) -> DataFrame:
    """(block_name, fingerprint): a block's name, population and variants with their indices and
    alleles, in any order: a sum of row hashes, so it is found by partial aggregation."""
    row = F.xxhash64("index", "site_ids", "position", "anc_alleles", "deriv_alleles")
    per = variants.groupBy("block_id").agg(F.count("*").alias("_n"), F.bit_xor(row).alias("_x"), F.sum(F.pmod(row, F.lit(1 << 40))).alias("_s"))
    named = blocks.select("block_id", F.col("name").alias("block_name"), *[F.col(c) for c in ("population",) if c in blocks.columns])
    more = [c for c in named.columns if c not in ("block_id", "block_name")]
    return named.join(per, "block_id").select("block_name", F.xxhash64("block_name", *more, "_n", "_x", "_s").alias("fingerprint"))


# Fixed values of a surrogate map's contract: its version, and what its indices count.
SURROGATE_FORMAT, SURROGATE_COORDINATES = "1", "block index"


def write_surrogates(map_: DataFrame, path: str, fingerprints: DataFrame | None = None) -> None:
    """(block_name, index, surrogate_index), one partition per block, never overwritten; with
    the fingerprints of the blocks it was made for, and the contract's version, beside it."""
    map_.write.partitionBy("block_name").mode("errorifexists").parquet(f"{path}/map")
    if fingerprints is not None:
        stamped = fingerprints.withColumns({"format": F.lit(SURROGATE_FORMAT), "coordinates": F.lit(SURROGATE_COORDINATES)})
        stamped.join(map_.select("block_name").distinct(), "block_name").coalesce(1).write.mode("errorifexists").parquet(f"{path}/blocks")


def read_surrogates(spark: SparkSession, path: str, block: str) -> DataFrame:
    return spark.read.parquet(f"{path}/map").where(F.col("block_name") == block)


def read_surrogate_map(spark: SparkSession, path: str, fingerprints: DataFrame) -> DataFrame:
    """The map, if it was made for these blocks; raises ValueError if it has no contract or
    another version, lacks a block, or if a block's variants or population differ."""
    try:
        made = spark.read.parquet(f"{path}/blocks")
    except AnalysisException as e:
        raise ValueError(f"{path} is no surrogate map with fingerprints; make it again") from e
    if not made.where((F.col("format") != SURROGATE_FORMAT) | (F.col("coordinates") != SURROGATE_COORDINATES)).isEmpty():
        raise ValueError(f"{path} is of another format; make it again")
    both = fingerprints.join(made.select("block_name", F.col("fingerprint").alias("_made")), "block_name", "left")
    other = [r.block_name for r in both.where(~F.col("_made").eqNullSafe(F.col("fingerprint"))).select("block_name").orderBy("block_name").limit(5).collect()]
    if other:
        raise ValueError(f"{path} was made for other blocks than {other}")
    return spark.read.parquet(f"{path}/map")


def write_tsv(df: DataFrame, path: str, one_file: bool = False) -> None:
    (df.coalesce(1) if one_file else df).write.mode("errorifexists").csv(path, sep="\t", header=True)


# The columns of a table of results.
RESULT_COLUMNS = ["name", *[f"{q}{s}" for q in ("enrichment", "heritability", "parameter") for s in ("", "_SE", "_log10pval")]]


def write_tall_results(rows: DataFrame, path: str) -> None:
    """One row per annotation, as comma-separated values; refuses to overwrite."""
    mine = {"name": "annotation"} | {c: c.replace("_SE", "_se").replace("_log10pval", "_log10p") for c in RESULT_COLUMNS[1:]}
    rows.select(*[F.col(mine[c]).alias(c) for c in RESULT_COLUMNS]).coalesce(1).write.mode("errorifexists").csv(path, header=True)


def write_convergence(fit: dict, path: str, spark: SparkSession) -> None:
    """Whether a fit converged, after how many iterations, and the likelihood of each."""
    rows = [(k, float(ll), bool(fit["converged"]), len(fit["likelihood"]) - 1) for k, ll in enumerate(fit["likelihood"])]
    write_tsv(spark.createDataFrame(rows, "iteration int, log_likelihood double, converged boolean, iterations int"), path, one_file=True)


def append_results(rows: DataFrame, path: str) -> None:
    """One row per trait behind those there are; the columns must agree."""
    spark = rows.sparkSession
    try:
        there = spark.read.csv(path, sep="\t", header=True).columns
    except AnalysisException:
        there = rows.columns
    if there != rows.columns:
        raise ValueError("the file has other columns")
    rows.coalesce(1).write.mode("append").csv(path, sep="\t", header=True)
