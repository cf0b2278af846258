"""Page loops of connectors over any ``send`` function: a query in, mapped records and warnings out.

``send(method, url, **options)`` gives (status, headers, body); retries and the cache are the transport's. A service hands out
pages one after the other, so a loop runs on the driver and holds no more than the ``max_records`` its query asks for;
mapping and checking are Column expressions on the rows it brings. Every record carries its provenance.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formula import composition_key_udf
from . import connectors as c
from .transport import ConnectorQuery, Policy, ResponseCache, request


@dataclass
class Fetched:
    """Records of a fetch, how many rows the service gave, and what was left out."""

    records: DataFrame
    n_rows: int
    warnings: list[str] = field(default_factory=list)


class FetchError(RuntimeError):
    """A response that is no success, or no JSON object."""


def _page(send, method: str, url: str, policy: Policy, cache: ResponseCache | None, **options) -> dict:
    status, _, body = request(send, method, url, policy, cache, **options)
    if status >= 400:
        raise FetchError(f"{url}: status {status}")
    page = json.loads(body) if isinstance(body, (str, bytes)) else body
    if not isinstance(page, dict):
        raise FetchError(f"{url}: no object")
    return page


def _bodies(spark: SparkSession, rows: list) -> DataFrame:
    return spark.createDataFrame([(json.dumps(r),) for r in rows], "body string")


def _told(spark: SparkSession, mapped: DataFrame, n: int, source: str, method: str, query: ConnectorQuery) -> Fetched:
    if query.properties:
        mapped = c.project_properties(mapped, list(query.properties), source)
    kept = mapped.count()
    records = mapped.withColumn("provenance", F.array(c.provenance(source, F.col("material_id"), method)))
    return Fetched(records, n, [f"{n - kept} malformed rows left out"] if kept < n else [])


def materials_project(spark: SparkSession, query: ConnectorQuery, send, policy: Policy = Policy(), cache: ResponseCache | None = None, url: str = "https://api.materialsproject.org/materials/summary/") -> Fetched:
    """By ids, else by elements; with neither no request is made. Pages of the query's size until enough, or a short one."""
    chosen = {"material_ids": ",".join(query.source_ids)} if query.source_ids else {"elements": ",".join(query.elements)} if query.elements else None
    rows: list = []
    for k in range(query.pages if chosen else 0):
        got = _page(send, "GET", url, policy, cache, params={**chosen, "_skip": k * query.page_size, "_limit": query.page_size}).get("data") or []
        rows += got
        if len(got) < query.page_size:
            break
    rows = rows[: query.max_records]
    return _told(spark, c.materials_project(_bodies(spark, rows)), len(rows), "materials_project", "dft", query)


def jarvis(rows: DataFrame, query: ConnectorQuery, order: str = "jid") -> Fetched:
    """A scan of saved rows with any of the elements, the first ones by id. Formulas that can't be read are only left out
    where elements are asked for; ids can't be asked for."""
    if query.source_ids:
        raise ValueError("jarvis is not asked by ids")
    if query.elements:
        found = F.regexp_extract_all(composition_key_udf("formula"), F.lit(r"([A-Z][a-z]?)"), F.lit(1))
        rows = rows.where(F.coalesce(c.elements_any(found, list(query.elements)), F.lit(False)))
    mapped = c.jarvis(rows.orderBy(order).limit(query.max_records))
    if query.properties:
        mapped = c.project_properties(mapped, list(query.properties), "jarvis")
    return Fetched(mapped.withColumn("provenance", F.array(c.provenance("jarvis", F.col("material_id"), "dft"))), query.max_records)


def nomad(spark: SparkSession, query: ConnectorQuery, send, policy: Policy = Policy(), url: str = "https://nomad-lab.eu/prod/v1/api/v1/entries/query") -> Fetched:
    """Pages by cursor until it ends or enough rows are there; properties and ids can't be asked for."""
    if query.properties or query.source_ids:
        raise ValueError("nomad is asked by elements only")
    rows: list = []
    after = None
    while len(rows) < query.max_records:
        size = min(query.page_size, query.max_records - len(rows))
        page = _page(send, "POST", url, policy, None, json=c.nomad_payload(list(query.elements), size, after))
        got = page.get("data") or []
        rows += got
        after = (page.get("pagination") or {}).get("next_page_after_value")
        if not got or not after:
            break
    rows = rows[: query.max_records]
    return _told(spark, c.nomad(_bodies(spark, rows)), len(rows), "nomad", "dft", query)


FIELDS = ("chemical_formula_reduced", "elements", "nsites", "nperiodic_dimensions", "dimension_types", "structure_features", "lattice_vectors", "cartesian_site_positions", "species_at_sites", "species")


def optimade(spark: SparkSession, query: ConnectorQuery, send, provider: str, base_url: str, policy: Policy = Policy(), cache: ResponseCache | None = None) -> Fetched:
    """Pages by the links they give until there is none or enough rows are there; all elements asked for must be in a record."""
    wanted = [*FIELDS, *(f for f, *_ in c._OQMD)] if provider == "oqmd" else list(FIELDS)
    params = {"response_fields": ",".join(wanted), "page_limit": min(query.page_size, query.max_records)}
    tests = ["elements HAS ALL " + ", ".join(f'"{e}"' for e in query.elements)] if query.elements else []
    if query.source_ids:
        tests.append("(" + " OR ".join(f'id="{i}"' for i in query.source_ids) + ")")
    if tests:
        params["filter"] = " AND ".join(tests)
    url, options, rows = f"{base_url.rstrip('/')}/structures", {"params": params}, []
    while url and len(rows) < query.max_records:
        page = _page(send, "GET", url, policy, cache, **options)
        got = page.get("data") or []
        rows += got
        if not got:
            break
        url, options = c.next_link(page), {}  # a link holds its own parameters
    rows = rows[: query.max_records]
    good, skipped = c.optimade(_bodies(spark, rows), provider)
    if query.properties:
        good = c.project_properties(good, list(query.properties), "optimade")
    warnings = [f"{r['id']}: {r['reason']}" for r in skipped.orderBy("id").collect()]  # at most max_records rows
    return Fetched(good.withColumn("provenance", F.array(c.provenance(f"optimade:{provider}", F.col("material_id"), "dft"))), len(rows), warnings)
