"""Ontologies as small tables: lineage, schema checks, differences, diagnostics.

An ontology is a Python dictionary, as its JSON file has it: types {name: {parents, keys, aliases}} and
predicates {name: {domain, range, cardinality, scope, inverse_of, symmetric, aliases, importance}}.
Its tables are as large as its declarations, so they are broadcast.
"""

from __future__ import annotations

import json
from difflib import get_close_matches

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LITERALS = ("string", "integer", "number", "float", "boolean", "date", "datetime", "quantity")
# The keys of the ontology format.
_PREDICATE_KEYS = frozenset("description domain range cardinality cardinality_scope qualifiers aliases importance inverse_of symmetric required examples label".split())
_TYPE_KEYS = frozenset("description parents keys aliases".split())


def load(text: str) -> dict:
    """Ontology from JSON text; an unknown key is an error that names its path and the nearest known key."""
    data = json.loads(text)
    for section, known in (("types", _TYPE_KEYS), ("predicates", _PREDICATE_KEYS)):
        for name, body in (data.get(section) or {}).items():
            for key in body or {}:
                if key not in known:
                    near = get_close_matches(key, known, 1)
                    raise ValueError(f"{section}.{name}.{key}: unknown key" + (f", did you mean {near[0]!r}?" if near else ""))
    return data


def types_table(spark: SparkSession, ontology: dict) -> DataFrame:
    rows = [(n, list(b.get("parents", [])), list(b.get("keys", [])), list(b.get("aliases", []))) for n,
        b in ontology.get("types", {}).items()]
    return spark.createDataFrame(rows, "name string, parents array<string>, keys array<string>, aliases array<string>")


def predicates_table(spark: SparkSession, ontology: dict) -> DataFrame:
    rows = [(n, list(b.get("domain", [])), b.get("range", "string"), b.get("cardinality", "multi"), list(b.get("cardinality_scope", [])),
        b.get("inverse_of"),
             bool(b.get("symmetric", False)), list(b.get("aliases", [])), float(b.get("importance", 0.0))) for n,
             b in ontology.get("predicates", {}).items()]
    return spark.createDataFrame(rows,
        "name string, domain array<string>, range string, cardinality string, scope array<string>, inverse_of string, symmetric boolean, "
                                       "aliases array<string>, importance double")


def lineage(spark: SparkSession, ontology: dict) -> DataFrame:
    """(type, ancestor), each type its own ancestor too; cycles end."""
    parents = {n: list(b.get("parents", [])) for n, b in ontology.get("types", {}).items()}
    rows = []
    for t in parents:
        seen, queue = {t}, [t]
        while queue:
            for p in parents.get(queue.pop(0), []):
                if p not in seen:
                    seen.add(p)
                    queue.append(p)
        rows += [(t, a) for a in sorted(seen)]
    return spark.createDataFrame(rows, "type string, ancestor string")


def inverses(spark: SparkSession, ontology: dict) -> DataFrame:
    """(predicate, inverse): mutual inverse edges, and symmetric ones with themselves."""
    p = ontology.get("predicates", {})
    edge = {n for n, b in p.items() if b.get("range") in ontology.get("types", {})}
    rows = [(n, n) for n in sorted(edge) if p[n].get("symmetric")]
    rows += [(n, i) for n in sorted(edge) if (i := p[n].get("inverse_of")) in edge and p[i].get("inverse_of") == n and i != n]
    return spark.createDataFrame(rows, "predicate string, inverse string")


def schema_problems(spark: SparkSession, facts: DataFrame, ontology: dict) -> DataFrame:
    """facts (predicate, s_type, o_type null for a value, others) with problem: predicate, domain, range or null, the
    first that fails. An ontology without predicates finds none."""
    if not ontology.get("predicates"):
        return facts.withColumn("problem", F.lit(None).cast("string"))
    preds = predicates_table(spark, ontology).select(F.col("name").alias("predicate"), "domain", "range",
        F.col("range").isin(*ontology.get("types", {}) or [""]).alias("edge"))
    line = lineage(spark, ontology).groupBy("type").agg(F.collect_set("ancestor").alias("up"))
    x = facts.join(F.broadcast(preds), "predicate", "left")
    x = x.join(F.broadcast(line.select(F.col("type").alias("s_type"), F.col("up").alias("s_up"))), "s_type", "left")
    x = x.join(F.broadcast(line.select(F.col("type").alias("o_type"), F.col("up").alias("o_up"))), "o_type", "left")
    s_up, o_up = F.coalesce("s_up", F.array("s_type")), F.coalesce("o_up", F.array("o_type"))
    problem = (F.when(F.col("range").isNull(), "predicate").when((F.size("domain") > 0) & ~F.arrays_overlap(s_up, "domain"), "domain")
               .when(F.col("edge") & (F.col("o_type").isNull() | ~F.array_contains(o_up, F.col("range"))),
               "range").when(~F.col("edge") & F.col("o_type").isNotNull(), "range"))
    return x.select(*facts.columns, problem.alias("problem"))


def entries(spark: SparkSession, ontology: dict) -> DataFrame:
    """(path, value) of every declaration, values as JSON."""
    rows = [(f"{section}.{n}.{k}", json.dumps(v, sort_keys=True)) for section in ("types", "predicates") for n,
        b in ontology.get(section, {}).items() for k, v in {"": True, **b}.items()]
    return spark.createDataFrame(rows, "path string, value string")


def snippet(ontology: dict, type_name: str, limit: int = 25) -> dict:
    """The predicates that a type may have, its ancestors' included, by importance and then name: at most `limit`."""
    types = ontology.get("types", {})
    up, queue = {type_name}, [type_name]
    while queue:
        new = [t for t in types.get(queue.pop(), {}).get("parents", []) if t not in up]
        up.update(new)
        queue += new
    fit = sorted((-float(b.get("importance", 0.0)), n) for n,
        b in ontology.get("predicates", {}).items() if not b.get("domain") or up & set(b["domain"]))
    return {"type": type_name, "predicates": [n for _, n in fit[:limit]], "truncated": len(fit) > limit}


def diff(spark: SparkSession, old: dict, new: dict) -> DataFrame:
    """path, change (added, removed, changed), breaking. Removals break, and so do changes of a domain, range or
    cardinality; an addition does not."""
    a, b = entries(spark, old).withColumnRenamed("value", "was"), entries(spark, new).withColumnRenamed("value", "now")
    x = a.join(b, "path", "full_outer").where(~F.col("was").eqNullSafe(F.col("now")))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed")
    return x.select("path", change.alias("change"),
        ((change == "removed") | ((change == "changed") & F.col("path").rlike(r"\.(?:domain|range|cardinality)$"))).alias("breaking"))


def diagnostics(ontology: dict) -> list[tuple[str, str]]:
    """(code, path) of everything that is wrong in a declaration."""
    types, preds, out = ontology.get("types", {}), ontology.get("predicates", {}), []
    for n, b in types.items():
        out += [("unknown_parent", f"types.{n}.parents") for p in b.get("parents", []) if p not in types]
        out += [("unknown_key", f"types.{n}.keys") for k in b.get("keys", []) if k not in preds]
    for n in types:
        seen, queue = set(), list(types[n].get("parents", []))
        while queue:
            p = queue.pop()
            if p == n:
                out.append(("inheritance_cycle", f"types.{n}.parents"))
                break
            if p not in seen:
                seen.add(p)
                queue += types.get(p, {}).get("parents", [])
    owner: dict[str, str] = {}
    for n, b in preds.items():
        at = f"predicates.{n}"
        out += [("unknown_domain", f"{at}.domain") for t in b.get("domain", []) if t not in types]
        if b.get("range", "string") not in types and b.get("range", "string") not in LITERALS:
            out.append(("unknown_range", f"{at}.range"))
        if b.get("cardinality", "multi") not in ("single", "multi"):
            out.append(("cardinality", f"{at}.cardinality"))
        if (i := b.get("inverse_of")) is not None:
            if i not in preds:
                out.append(("unknown_inverse", f"{at}.inverse_of"))
            elif preds[i].get("inverse_of") not in (None, n):
                out.append(("one_sided_inverse", f"{at}.inverse_of"))
        if b.get("symmetric") and b.get("range") not in types:
            out.append(("symmetric_value", f"{at}.symmetric"))
        out += [("unknown_scope", f"{at}.cardinality_scope") for q in b.get("cardinality_scope", []) if q not in b.get("qualifiers", {})]
        for a in (n, *b.get("aliases", [])):
            if owner.setdefault(a.casefold(), n) != n:
                out.append(("shared_alias", f"{at}.aliases"))
    return sorted(set(out))


def from_schema(name: str, schemas: dict, version: str = "1") -> dict:
    """An ontology from Spark schemas by type name: a field is a predicate of its type, a nested struct an edge to a type named by
    its metadata `type` (or its field), an array holds many values, a field that may not be null is required."""
    from pyspark.sql import types as T

    kinds = {T.StringType: "string", T.BooleanType: "boolean", T.DateType: "date", T.TimestampType: "datetime",
        T.TimestampNTZType: "datetime",
             T.ByteType: "integer", T.ShortType: "integer", T.IntegerType: "integer", T.LongType: "integer", T.FloatType: "number",
             T.DoubleType: "number", T.DecimalType: "number"}
    types: dict[str, dict] = {}
    predicates: dict[str, dict] = {}

    def add(type_name: str, schema) -> None:
        if type_name in types:
            return
        types[type_name] = {}
        for f in schema.fields:
            kind, many = f.dataType, False
            if isinstance(kind, T.ArrayType):
                kind, many = kind.elementType, True
            if isinstance(kind, T.StructType):
                to = f.metadata.get("type") or "".join(w.capitalize() for w in f.name.split("_"))
                add(to, kind)
            else:
                to = kinds.get(type(kind), "string")
            p = predicates.setdefault(f.name,
                {"domain": [], "range": to, "cardinality": "multi" if many else "single", "required": not f.nullable})
            if p["range"] != to:
                raise ValueError(f"{type_name}.{f.name}: range {to}, but {p['range']} elsewhere")
            p["domain"].append(type_name)

    for type_name, schema in schemas.items():
        add(type_name, schema)
    return {"name": name, "version": version, "types": types, "predicates": predicates}
