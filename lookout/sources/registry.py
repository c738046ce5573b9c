"""The brand registry: YAML documents with overlay, as one DataFrame per list, and the checks across lists."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lookout.functions import names

_PROVENANCE = "provenance array<struct<source:string,recorded_by:string,recorded_at:date,verified_by:string,verified_at:date,note:string>>"
SCHEMAS = {
    "brands": f"id string, name string, aliases array<string>, status string, {_PROVENANCE}",
    "keywords": f"brand string, term string, tier string, fuzzy boolean, status string, {_PROVENANCE}",
    "context_terms": f"term string, status string, {_PROVENANCE}",
    "exclusions": f"term string, scope string, status string, {_PROVENANCE}",
    "domains": f"name string, brand string, kind string, suppresses boolean, status string, {_PROVENANCE}",
    "relationships": f"from string, to string, type string, status string, {_PROVENANCE}",
    "payees": f"id string, name string, brand string, status string, identifiers array<struct<type:string,value:string>>, {_PROVENANCE}",
    "reference_pages": f"url string, brand string, status string, {_PROVENANCE}",
    "reference_assets": f"id string, brand string, kind string, path string, url string, sha256 string, status string, {_PROVENANCE}",
}
DEFAULTS = {"fuzzy": False, "kind": "official", "suppresses": False, "aliases": [], "identifiers": [], "provenance": []}
STATUSES = ("confirmed", "candidate", "legacy-unverified", "rejected")


@dataclass
class Registry:
    """Plain rows by list; small by nature, so it may live on the driver and be sent to workers."""

    lists: dict[str, list[dict]] = field(default_factory=lambda: {k: [] for k in SCHEMAS})

    def rows(self, name: str, active: bool = True) -> list[dict]:
        return [r for r in self.lists[name] if not active or r.get("status") != "rejected"]

    def frame(self, spark: SparkSession, name: str) -> DataFrame:
        schema = T._parse_datatype_string(SCHEMAS[name])
        rows = [tuple(_fitted(r.get(f.name, DEFAULTS.get(f.name)), f.dataType) for f in schema.fields) for r in self.lists[name]]
        return spark.createDataFrame(rows, schema)


def _fitted(value, kind: T.DataType):
    if isinstance(kind, T.ArrayType):
        return [_fitted(v, kind.elementType) for v in value or []]
    if isinstance(kind, T.StructType):
        return tuple(_fitted(value.get(f.name), f.dataType) for f in kind.fields)
    return value


def load(path: str, overlay: str | None = None) -> Registry:
    """Read a registry document and append an overlay's lists. Keywords move out of their brands into a list of their own."""
    import yaml

    out = Registry()
    for p in filter(None, (path, overlay)):
        with open(p, encoding="utf-8") as f:
            doc = yaml.safe_load(f) or {}
        unknown = set(doc) - set(SCHEMAS) - {"version"}
        if unknown:
            raise ValueError(f"{p}: unknown lists {sorted(unknown)}")
        for name, rows in doc.items():
            for row in rows if name in SCHEMAS else ():
                out.lists["keywords"] += [{**DEFAULTS, **k, "brand": row["id"]} for k in row.get("keywords") or ()]
                out.lists[name].append({**DEFAULTS, **{k: v for k, v in row.items() if k != "keywords"}})
    return out


def from_terms(terms: DataFrame, most: int = 100_000) -> Registry:
    """A registry of a brand_terms table: strong phrases are high-tier keywords, weak ones low; letters and digits only, of any length."""
    rows = terms.select("brand", "brand_name", "phrase", "strength").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} terms: use the joins of lookout.operators.joins instead of a matcher on workers")
    out, seen = Registry(), set()
    for r in sorted(rows, key=str):
        term = "".join(c for c in names.skeleton(r.phrase or "") if c.isalnum())
        if term and (r.brand, term) not in seen:
            seen.add((r.brand, term))
            out.lists["keywords"].append({"brand": r.brand, "term": term, "tier": "high" if r.strength == "strong" else "low", "fuzzy": r.strength == "strong", "status": "confirmed"})
    out.lists["brands"] = [{"id": b, "name": b, "status": "confirmed"} for b in sorted({r.brand for r in rows if r.brand})]
    return out


def problems(spark: SparkSession, registry: Registry) -> DataFrame:
    """level (error, warning), list, entry, problem: the checks across lists as joins between their frames."""
    f = {k: registry.frame(spark, k) for k in SCHEMAS}
    found: list[DataFrame] = []

    def add(rows: DataFrame, of: str, entry, problem: str, level: str = "error") -> None:
        found.append(rows.select(F.lit(level).alias("level"), F.lit(of).alias("list"), entry.alias("entry"), F.lit(problem).alias("problem")))

    for of, key in (("brands", "id"), ("keywords", "term"), ("context_terms", "term"), ("domains", "name"), ("payees", "id"), ("reference_pages", "url"), ("reference_assets", "id")):
        add(f[of].groupBy(F.col(key).alias("_k")).count().where("count > 1"), of, F.col("_k"), "duplicate")
    add(f["exclusions"].groupBy("term", "scope").count().where("count > 1"), "exclusions", F.col("term"), "duplicate")
    for of, frame in f.items():
        add(frame.where(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))), of, F.col(frame.columns[0]), "unknown status")
    add(f["keywords"].where("tier = 'low' and fuzzy"), "keywords", F.col("term"), "low-tier keywords can't be fuzzy")
    terms = f["keywords"].select(F.col("term").alias("_term")).distinct()
    add(f["exclusions"].join(terms, F.col("scope") == F.col("_term"), "left_anti"), "exclusions", F.col("term"), "scope is no keyword")
    add(f["exclusions"].join(terms, F.col("scope") == F.col("_term"), "left_semi").where(~F.contains("term", "scope")), "exclusions", F.col("term"), "can never apply", "warning")
    brands = f["brands"].select(F.col("id").alias("_brand"))
    for of, key in (("domains", "name"), ("payees", "id"), ("reference_pages", "url"), ("reference_assets", "id")):
        add(f[of].join(brands, F.col("brand") == F.col("_brand"), "left_anti"), of, F.col(key), "unknown brand")
    forms = names.with_forms(f["domains"], "name", "_f")
    add(forms.where("_f.host is null"), "domains", F.col("name"), "no DNS name")
    add(forms.where("_f.host <> name or _f.wildcard"), "domains", F.col("name"), "not canonical")
    add(forms.where("_f.host = name and _f.registrable_domain = ''"), "domains", F.col("name"), "a public suffix")
    ids = f["brands"].select(F.concat(F.lit("brand:"), "id").alias("_ref")).unionByName(f["domains"].select(F.concat(F.lit("domain:"), "name").alias("_ref"))).unionByName(f["payees"].select(F.concat(F.lit("payee:"), "id").alias("_ref")))
    for end in ("from", "to"):
        add(f["relationships"].join(ids, F.col(f"`{end}`") == F.col("_ref"), "left_anti"), "relationships", F.col(f"`{end}`"), "unknown reference")
    add(f["domains"].where("suppresses and status <> 'confirmed'"), "domains", F.col("name"), "only confirmed domains may suppress")
    allowed = f["relationships"].where("status = 'confirmed' and type = 'authorized_domain'").select(F.col("`from`").alias("_from"), F.col("`to`").alias("_to"))
    third = f["domains"].where("suppresses and status = 'confirmed' and kind = 'third_party'")
    add(third.join(allowed, (F.concat(F.lit("brand:"), "brand") == F.col("_from")) & (F.concat(F.lit("domain:"), "name") == F.col("_to")), "left_anti"), "domains", F.col("name"), "no authorizing relationship")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def counts(spark: SparkSession, registry: Registry) -> DataFrame:
    """list, status, n."""
    out = None
    for name in SCHEMAS:
        part = registry.frame(spark, name).groupBy("status").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("list"), "status", "n")
        out = part if out is None else out.unionByName(part)
    return out


def uncovered(legacy: DataFrame, registry_frame: DataFrame, key: str) -> DataFrame:
    """Legacy constants (kind, value, source) that no registry entry covers, or that cite another source."""
    r = registry_frame.select(F.col(key).alias("_key"), F.transform("provenance", lambda p: p["source"]).alias("_sources"))
    joined = legacy.join(r, F.col("value") == F.col("_key"), "left")
    return joined.where(F.col("_key").isNull() | ~F.array_contains("_sources", F.col("source"))).select("kind", "value", "source")
