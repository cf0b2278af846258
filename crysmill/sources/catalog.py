"""Named datasets on disk with least-recently-used bookkeeping, and functions in place of a web service's routes."""

from __future__ import annotations

import json
import threading
from collections import OrderedDict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, simulation
from ..operators.dataset import MaterialsDataset, SliceError
from ..operators.normalize import structure_faults
from ..operators.scorecard import Scorecard
from ..runtime import _fs, delete, read_bytes, write_bytes
from .readers import canonical_lines, lines_digest


class Evicted(KeyError):
    """The dataset was there and made room for others."""


class Catalog:
    """Datasets as parquet folders under ``path``: at most ``max_entries`` of them and ``max_bytes`` together, the least
    recently used ones going first, folder and all. An index file keeps the order over reopenings; the last 64 ids that
    went are remembered."""

    def __init__(self, spark: SparkSession, path: str, max_entries: int = 8, max_bytes: int | None = None):
        if max_entries < 1:
            raise ValueError("max_entries must be at least 1")
        self.spark, self.path, self.max_entries, self.max_bytes = spark, path.rstrip("/"), max_entries, max_bytes
        self._lock = threading.RLock()
        self._active: tuple[str, DataFrame] | None = None
        kept = json.loads(read_bytes(spark, f"{self.path}/_index.json") or b"{}")
        self._entries: OrderedDict[str, dict] = OrderedDict(kept.get("entries", []))
        self._gone: OrderedDict[str, None] = OrderedDict.fromkeys(kept.get("gone", []))

    def _save(self) -> None:
        write_bytes(self.spark, f"{self.path}/_index.json", json.dumps({"entries": list(self._entries.items()), "gone": list(self._gone)}).encode())

    def register(self, dataset_id: str, df: DataFrame, manifest: dict | None = None) -> None:
        """Writes a dataset, which makes it the one used last; one of more than ``max_bytes`` raises ValueError."""
        with self._lock:
            where = f"{self.path}/{dataset_id}"
            df.write.mode("overwrite").parquet(where)
            fs, folder = _fs(self.spark, where)
            size = fs.getContentSummary(folder).getLength()
            if self.max_bytes is not None and size > self.max_bytes:
                delete(self.spark, where)
                raise ValueError(f"{dataset_id} has more than {self.max_bytes} bytes")
            self._entries.pop(dataset_id, None)
            self._entries[dataset_id] = {"manifest": dict(manifest or {}), "bytes": size}
            self._gone.pop(dataset_id, None)
            while len(self._entries) > self.max_entries or self.max_bytes is not None and self.total_bytes > self.max_bytes:
                old, _ = self._entries.popitem(last=False)
                self._gone[old] = None
                while len(self._gone) > 64:
                    self._gone.popitem(last=False)
                self._release(old)
            self._save()

    @property
    def total_bytes(self) -> int:
        return sum(e["bytes"] for e in self._entries.values())

    def _release(self, dataset_id: str) -> None:
        if self._active and self._active[0] == dataset_id:
            self._active[1].unpersist()
            self._active = None
        delete(self.spark, f"{self.path}/{dataset_id}")

    def _known(self, dataset_id: str) -> dict:
        if dataset_id not in self._entries:
            raise Evicted(dataset_id) if dataset_id in self._gone else KeyError(dataset_id)
        return self._entries[dataset_id]

    def materialize(self, dataset_id: str) -> DataFrame:
        """The dataset's rows, persisted; the one before is released first."""
        with self._lock:
            self._known(dataset_id)
            self._entries.move_to_end(dataset_id)
            self._save()
            if self._active and self._active[0] == dataset_id:
                return self._active[1]
            if self._active:
                self._active[1].unpersist()
            self._active = (dataset_id, self.spark.read.parquet(f"{self.path}/{dataset_id}").persist())
            return self._active[1]

    def list(self) -> list[str]:
        return list(self._entries)

    def get(self, dataset_id: str) -> dict:
        return self._known(dataset_id)["manifest"]

    def status(self, dataset_id: str) -> str:
        """present, evicted or unknown."""
        return "present" if dataset_id in self._entries else "evicted" if dataset_id in self._gone else "unknown"

    def export(self, dataset_id: str, path: str) -> dict:
        """Canonical lines of a dataset under ``path``, with its id, checksum and count."""
        self._known(dataset_id)
        canonical_lines(self.spark.read.parquet(f"{self.path}/{dataset_id}")).write.mode("overwrite").text(path)
        count, digest = lines_digest(self.spark.read.text(path))
        return {"dataset_id": dataset_id, "sha256": digest, "count": count}

    def delete(self, dataset_id: str) -> None:
        if not self._lock.acquire(blocking=False):
            raise RuntimeError("the dataset is in use")
        try:
            self._entries.pop(dataset_id)
            self._release(dataset_id)
            self._save()
        finally:
            self._lock.release()

    def clear(self) -> None:
        for d in self.list():
            self.delete(d)

    def stats(self) -> dict:
        return {"entry_count": len(self._entries), "normalized_bytes": self.total_bytes, "max_entries": self.max_entries, "max_normalized_bytes": self.max_bytes, "active_dataset_id": self._active[0] if self._active else None, "eviction_policy": "least_recently_used"}


def slice_preview(dataset: MaterialsDataset, name: str, rows: int = 20, **pool) -> dict:
    """Slice report, first ids, graph readiness and the first benchmark rows of a candidate pool."""
    chosen = dataset.candidate_pool(**pool)
    try:
        made = chosen.create_slice(name, allow_duplicate_records=True, allow_mixed_functionals=True)
    except SliceError as e:
        return {"error": str(e)}
    ready = F.coalesce(F.size(structure_faults(F.col("structure"))) == 0, F.lit(False))
    one = made.df.agg(F.count_if(ready), F.count_if(~ready)).first()
    return {"slice": made.report(), "material_ids": [r[0] for r in made.df.select("material_id").orderBy("material_id").limit(rows).collect()], "graph_readiness": {"included_count": one[0], "excluded_count": one[1]}, "benchmark_preview": [r.asDict() for r in chosen.to_benchmark_frame().select("material_id", "formula").orderBy("material_id").limit(3).collect()]}


def rank_audit(card: Scorecard, df: DataFrame, id_key: str = "material_id") -> tuple[DataFrame, dict]:
    """(ranking with the constraint columns added, report)."""
    ranked = card.rank(df, id_key)
    more = [c for c in card.constraints if c in df.columns and c not in ranked.columns]
    joined = ranked.join(df.select(id_key, *more).dropDuplicates([id_key]), id_key, "left") if more else ranked
    return joined, card.report(df)


def search(df: DataFrame, element: str | None = None) -> DataFrame:
    """Records with an element, all without one."""
    return df.where(F.array_contains("elements", element)) if element else df


def point_lookup(df: DataFrame, wanted, id_key: str = "material_id") -> DataFrame:
    """One record of an id; the comparison reaches the scan."""
    return df.where(F.col(id_key) == wanted).limit(1)


def workflow(dataset: MaterialsDataset, card: Scorecard, name: str, **pool) -> dict:
    """Pool, slice and ranking in one go: slice report and the first three of the ranking."""
    chosen = dataset.candidate_pool(**pool)
    made = chosen.create_slice(name, allow_duplicate_records=True, allow_mixed_functionals=True)
    return {"slice": made.report(), "leaders": [r.asDict() for r in card.rank(made.df).limit(3).collect()], "ranking": card.report(made.df)}


def default_leader(card: Scorecard, df: DataFrame, id_key: str = "material_id") -> str | None:
    """The first of the ranking, else the first id of all; None for an empty table."""
    first = card.rank(df, id_key).select(id_key).first() or df.select(id_key).where(F.col(id_key).isNotNull()).orderBy(id_key).first()
    return first[0] if first else None


def constraint_verdict(force: Column, hull: Column, max_force: float, max_hull: float) -> Column:
    """STRUCT(state, label): which bound a record fails first, force before hull; empty state without any value."""
    f, h = F.nanvl(force, F.lit(None)), F.nanvl(hull, F.lit(None))
    say = lambda state, label: F.struct(F.lit(state).alias("state"), F.lit(label).alias("label"))
    return F.when(f.isNull() & h.isNull(), say("", "no data")).when(f > max_force, say("fail", "force")).when(h > max_hull, say("fail", "hull")).otherwise(say("pass", "pass"))


def slice_readiness(chosen: DataFrame, store: DataFrame, id_key: str = "material_id") -> dict:
    """How many records of a slice have a structure in the store that a graph can be made of; the store's last row of an id counts."""
    ready = F.coalesce(F.size(structure_faults(F.col("structure"))) == 0, F.lit(False))
    order = "row_no" if "row_no" in store.columns else id_key
    last = store.groupBy(id_key).agg(F.max_by(ready, F.col(order)).alias("ready"))
    one = chosen.select(id_key).join(last, id_key, "left").agg(F.count_if(F.col("ready")), F.count_if(~F.coalesce("ready", F.lit(False)))).first()
    return {"included_count": one[0], "excluded_count": one[1]}


def preflight(df: DataFrame, card: Scorecard, id_key: str = "material_id", cutoff: float = 5.0, k: int = 12, reference: bool = False) -> dict:
    """Whether a table is fit for use: graphs, ranking and readiness as counts, with a status for each check."""
    states = {r["state"]: r["n"] for r in graph.summary(df.select(id_key, "structure"), id_key, cutoff, k, 0).groupBy("state").agg(F.count("*").alias("n")).collect()}  # three states
    total = sum(states.values())
    ok, invalid = states.get("valid", 0) + states.get("invalid", 0), states.get("invalid", 0)
    ranking = card.report(df)
    targets = {r["reason"] or "ready": r["n"] for r in simulation.readiness(df.withColumn("material_id", F.col(id_key))).groupBy(F.substring_index("reason", ":", 1).alias("reason")).agg(F.count("*").alias("n")).collect()}
    good_graphs = bool(ok) and not invalid
    checks = [
        {"id": "fixture", "status": "pass" if total else "fail", "detail": f"{total} records"},
        {"id": "graphs", "status": "pass" if good_graphs else "fail", "detail": f"{ok} with a graph, {states.get('excluded', 0)} without, {invalid} invalid"},
        {"id": "ranking", "status": "pass" if ranking["ranked_count"] >= 3 else "warn", "detail": f"{ranking['ranked_count']} ranked, {ranking['excluded_by_constraints']} excluded"},
        {"id": "ml_reference", "status": "pass" if reference else "warn", "detail": "there" if reference else "missing"},
    ]
    return {
        "status": "ready" if all(x["status"] == "pass" for x in checks) else "degraded", "record_count": total,
        "graph": {"included_count": ok, "excluded_count": states.get("excluded", 0), "invalid_count": invalid, "validation_state": "valid" if good_graphs else "invalid"},
        "ranking": {k: ranking[k] for k in ("ranked_count", "excluded_by_constraints", "binary_normalization")}, "default_material_id": default_leader(card, df, id_key), "simulation_targets": targets, "checks": checks,
    }


# (id, what it is, group, where it is) of everything on offer.
CAPABILITIES = (
    ("bulk_adapter", "Bulk source with strict guardrails", "workflow", "operators.dataset.MaterialsDataset.bulk"),
    ("candidate_slices", "Audited slices and guardrails", "workflow", "operators.dataset.CandidateSlice.report"),
    ("crystal_graphs", "Neighbour graphs", "graphs", "operators.graph.summary"),
    ("benchmark_frames", "Frames for benchmarks", "benchmarks", "operators.dataset.MaterialsDataset.to_benchmark_frame"),
    ("scorecard_audit", "Ranking with audit", "ranking", "operators.scorecard.Scorecard.report"),
    ("local_import", "Checked import of uploads", "workflow", "sources.importer.import_content"),
    ("relax", "Relaxation by an installed simulator", "simulation", "operators.simulation.run_job"),
    ("result_import", "Imported result envelopes", "simulation", "operators.simulation.envelopes"),
    ("connectors", "Remote sources over a given transport", "sources", "sources.fetch"),
    ("oqmd", "Native OQMD source", "sources", None),
    ("lammps", "LAMMPS runs", "simulation", None),
    ("quantum_espresso", "Quantum ESPRESSO runs", "simulation", None),
)


def capabilities(spark: SparkSession) -> DataFrame:
    """(id, title, category, state, evidence): what is offered, what needs a simulator that isn't installed, and what isn't."""
    state = lambda i, where: "not_offered" if where is None else "needs_install" if i == "relax" and not simulation.ase_there() else "offered"
    return spark.createDataFrame([(i, t, g, state(i, where), where) for i, t, g, where in CAPABILITIES], "id string, title string, category string, state string, evidence string")
