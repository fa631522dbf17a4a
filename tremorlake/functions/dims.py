"""Constant tables of the impact model, as small DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

HIGH, MEDIUM, LOW = "Tinggi", "Menengah", "Rendah"
CHUNKS = ("FR", "NFR", "Design", "General")
RRF_PATHS = ("dense_doc", "bm25_doc", "dense_code", "bm25_code")
#: weights in the order of RRF_PATHS
RRF = {"ADDITION": (1.2, 1.0, 1.0, 0.8), "DELETION": (1.0, 0.8, 1.2, 1.0), "MODIFICATION": (1.0, 1.0, 1.2, 1.0)}
RRF_K = 60
#: factors in the order of CHUNKS; "None" is for unclassified files
COMPAT = {"None": (0.8, 0.5, 0.8, 0.6), "UTILITY": (1.0, 0.7, 1.0, 0.8), "UI_COMPONENT": (0.9, 0.5, 0.9, 0.7), "TYPE_DEFINITION": (0.8, 0.3, 1.0, 0.6), "PAGE_COMPONENT": (1.0, 0.5, 0.9, 0.7), "API_ROUTE": (1.0, 0.6, 0.9, 0.8)}
#: order in which a vertex's edges are followed; backward (b) or forward (f), largest depth, severity, weight of label propagation
EDGES = """CALLS b 2 M .9
INHERITS b 3 M .7
IMPLEMENTS b 3 H .7
TYPED_BY b 3 H .8
FIELDS_ACCESSED b 2 H .7
DEFINES_METHOD f 1 M .6
PASSES_CALLBACK f 1 M .5
HOOK_DEPENDS_ON b 1 M .6
IMPORTS b 1 L .5
RENDERS b 1 L .8
DEPENDS_ON_EXTERNAL b 1 L 0
CLIENT_API_CALLS b 1 L .7
DYNAMIC_IMPORT b 1 L .4
CONTAINS b 1 L .6"""
EXEMPT = ("DEFINES_METHOD", "IMPLEMENTS")
FAN_IN = {"File": 200, "InterfaceField": 200, "Variable": 80, "ExternalPackage": 0} | dict.fromkeys(("Interface", "TypeAlias", "Enum"), 100) | dict.fromkeys(("Class", "Function", "Method"), 50)
NEVER = "ExternalPackage"
STOP = sorted("the and for are but not you all can has had was via any out our off per yet too use dan ini itu atau yang nya kan lah pun bagi agar akan ada ialah".split() + "of to in on at by is be as an or if it we us do no so up di ke ya".split())
INDONESIAN = (" yang ", " untuk ", " dan ", " dengan ", "tambahkan", "menambahkan")
#: largest lengths of texts in prompts and reports
CUT = {"abstraction": 1200, "sibling": 800, "snippet": 500, "entity": 400, "reason": 300, "file": 600}
#: layers of a request's queries, by the class of the files that they are for
LAYERS = {"api_route": "API_ROUTE", "page_component": "PAGE_COMPONENT", "ui_component": "UI_COMPONENT", "utility": "UTILITY", "type_definition": "TYPE_DEFINITION"}
RANK = {HIGH: 0, MEDIUM: 1, LOW: 2}


def edge_rows() -> list[tuple[str, int, str, int, str, float]]:
    """(edge_type, ord, direction, max_depth, severity, weight)"""
    out = []
    for i, line in enumerate(EDGES.split("\n")):
        name, way, depth, severity, weight = line.split()
        out.append((name, i, {"b": "reverse", "f": "forward"}[way], int(depth), {"H": HIGH, "M": MEDIUM, "L": LOW}[severity], float(weight)))
    return out


def edge_config(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(edge_rows(), "edge_type string, ord int, direction string, max_depth int, severity string, weight double")


def compat() -> dict[tuple[str, str], float]:
    """Factor by file class ("None" for unclassified files) and chunk type."""
    return {(c, t): f for c, row in COMPAT.items() for t, f in zip(CHUNKS, row)}


def layer_compat(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, t, f) for (c, t), f in compat().items()], "file_class string, chunk_type string, compat double")


def rrf_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, p, w) for c, row in RRF.items() for p, w in zip(RRF_PATHS, row)], "change_type string, path string, weight double")


def fan_in(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FAN_IN.items()), "node_type string, max_fan_in int")


def values(rows: list[tuple], alias: str, columns: str) -> str:
    """The same rows as a SQL VALUES list."""
    lit = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"CAST({x} AS DOUBLE)" if isinstance(x, float) else str(x)
    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS {alias}({columns})"
