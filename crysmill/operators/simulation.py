"""Simulation readiness, relaxations by an installed or given simulator, structured failures, and imported result envelopes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements of the effective-medium potential.
EMT = ("Al", "Ni", "Cu", "Pd", "Ag", "Pt", "Au", "H", "C", "N", "O")
ENGINES = {"ase": "ase_missing", "lammps": "not_implemented", "quantum_espresso": "not_implemented"}
ENVELOPE = "engine string, method string, job_id string, input_checksum string, output_checksum string, converged boolean, energy double, warnings array<string>, parameters map<string,string>"


def ase_there() -> bool:
    try:
        import ase  # noqa: F401
    except ImportError:
        return False
    return True


def readiness(df: DataFrame, installed: bool | None = None) -> DataFrame:
    """(material_id, ready, reason): the first reason that stands in the way, null for none."""
    installed = ase_there() if installed is None else installed
    species = F.col("structure.species")
    unsupported = F.array_except(species, F.array(*map(F.lit, EMT)))
    reason = F.when(F.coalesce(F.size(species), F.lit(0)) < 1, "no structure").when(F.size(unsupported) > 0, F.concat(F.lit("unsupported: "), F.array_join(F.array_sort(unsupported), ", ")))
    if not installed:
        reason = F.when(F.lit(True), "simulator not installed")
    return df.select("material_id", reason.isNull().alias("ready"), reason.alias("reason"))


def run_job(df: DataFrame, engine: str, kind: str = "relax") -> DataFrame:
    """(job_id, material_id, engine, status, error): what becomes of jobs that can't run: engines that are not offered,
    other kinds than relax, or a simulator that isn't installed. ``relax`` runs those that can."""
    if engine not in ENGINES:
        raise ValueError(f"engine must be one of {sorted(ENGINES)}")
    error = "only relax is offered" if engine == "ase" and kind != "relax" else ENGINES[engine]
    return df.select(F.uuid().alias("job_id"), "material_id", F.lit(engine).alias("engine"), F.lit("failed").alias("status"), F.lit(error).alias("error"))


RELAXED = "job_id string, material_id string, engine string, calculator string, status string, error string, converged boolean, steps int, energy double, max_force double, log string, lattice array<array<double>>, species array<string>, coords array<array<double>>"


def relax(df: DataFrame, fmax: float = 0.05, max_steps: int = 200, calculator=None) -> DataFrame:
    """Relaxations of (material_id, structure), one row each, by an installed ASE or by ``calculator(lattice, species, coords,
    fmax, max_steps)``, which gives (converged, steps, energy, max_force, lattice, coords). A structure that is missing or has
    unsupported species, and any error of the calculator, give a failed job with its reason; jobs run apart on the workers.
    """
    faults = job_faults(fmax=fmax, max_steps=max_steps)
    if faults:
        raise ValueError(f"settings out of bounds: {faults}")
    own = calculator is None

    def run(batches):
        import pandas as pd

        work = _ase_relax if own else calculator
        for pdf in batches:
            out = []
            for job, ident, reason, lattice, species, coords in pdf.itertuples(index=False):
                row = dict.fromkeys(["error", "converged", "steps", "energy", "max_force", "log", "lattice", "species", "coords"])
                row |= {"job_id": job, "material_id": ident, "engine": "ase", "calculator": "emt" if own else "own", "status": "failed"}
                if reason:
                    row["error"] = reason
                else:
                    cell, names, places = [list(map(float, v)) for v in lattice], list(species), [list(map(float, v)) for v in coords]
                    try:
                        done, steps, energy, force, cell, places = work(cell, names, places, fmax, max_steps)
                        row |= {"status": "completed", "converged": bool(done), "steps": int(steps), "energy": float(energy), "max_force": float(force), "log": f"energy={energy} max_force={force} steps={steps} converged={done}", "lattice": cell, "species": names, "coords": places}
                    except Exception as e:  # noqa: BLE001
                        row["error"] = f"{type(e).__name__}: {e}"
                out.append(row)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RELAXED.split(", ")])

    known = F.array_except("structure.species", F.array(*map(F.lit, EMT))) if own else F.array().cast("array<string>")
    bad = F.when(F.coalesce(F.size("structure.species"), F.lit(0)) < 1, "no structure").when(F.size(known) > 0, F.concat(F.lit("unsupported: "), F.array_join(F.array_sort(known), ", ")))
    if own and not ase_there():
        bad = F.coalesce(bad, F.lit(ENGINES["ase"]))
    jobs = df.select(F.uuid().alias("job_id"), F.col("material_id").cast("string").alias("material_id"), bad.alias("reason"), F.col("structure.lattice").alias("lattice"), F.col("structure.species").alias("species"), F.col("structure.coords").alias("coords"))
    return jobs.mapInPandas(run, RELAXED)


def _ase_relax(lattice, species, coords, fmax, max_steps):
    """One relaxation by ASE's effective-medium calculator."""
    import numpy as np
    from ase import Atoms
    from ase.calculators.emt import EMT as Calculator
    from ase.optimize import BFGS

    atoms = Atoms(species, scaled_positions=coords, cell=lattice, pbc=True)
    atoms.calc = Calculator()
    run = BFGS(atoms, logfile=None)
    done = run.run(fmax=fmax, steps=max_steps)
    force = float(np.linalg.norm(atoms.get_forces(), axis=1).max())
    return done, run.nsteps, atoms.get_potential_energy(), force, atoms.cell.tolist(), atoms.get_scaled_positions().tolist()


def job_faults(calculator: str = "emt", fmax: float = 0.05, max_steps: int = 200, n_cores: int = 1) -> list[str]:
    """What is wrong with a job's settings."""
    tests = {"calculator": calculator == "emt", "fmax": fmax > 0, "max_steps": max_steps >= 1, "n_cores": n_cores >= 1}
    return [k for k, ok in tests.items() if not ok]


def _checksum(c: Column) -> Column:
    return F.coalesce(F.lower(c).rlike(r"^[0-9a-f]{64}$"), F.lit(True))


def envelopes(df: DataFrame, payload: str) -> DataFrame:
    """Result envelopes of JSON text with ``fault``: not_object, engine_empty, method_empty or checksum."""
    e = df.withColumn("_e", F.from_json(payload, ENVELOPE)).withColumn("_ok", F.schema_of_variant(F.try_parse_json(payload)).like("OBJECT%"))
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    fault = F.when(~F.coalesce("_ok", F.lit(False)), "not_object").when(blank(F.col("_e.engine")), "engine_empty").when(blank(F.col("_e.method")), "method_empty").when(~_checksum(F.col("_e.input_checksum")) | ~_checksum(F.col("_e.output_checksum")), "checksum")
    return e.select(*df.columns, "_e.*", fault.alias("fault"))


def valid_sha256(text: str) -> bool:
    return re.fullmatch(r"[0-9a-fA-F]{64}", text) is not None
