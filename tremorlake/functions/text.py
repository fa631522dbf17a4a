"""Scalar functions over text, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from . import dims


def split_camel(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")


def tokenise(c: Column, stop: Sequence[str] = dims.STOP) -> Column:
    """Lower-case alphanumeric tokens of two characters or more, camel case split, without numbers and stop words."""
    words = F.split(F.lower(split_camel(c)), "[^a-z0-9]+")
    keep = lambda t: (F.length(t) >= 2) & ~t.rlike("^[0-9]+$") & ~t.isin(*stop)
    return F.filter(words, keep)


def slugify(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))


def readable_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, "([A-Z])", " $1"), " +", " "))


def last_segment(c: Column) -> Column:
    return F.element_at(F.split(c, "::"), -1)


def file_part(c: Column) -> Column:
    return F.regexp_extract(c, "^(.*)::(.*)$", 1)


def contains_any(c: Column, needles: Sequence[str] | Column, least: int = 1) -> Column:
    """Whether the lower-cased text holds a needle of at least `least` characters."""
    if isinstance(needles, Column):
        return F.exists(needles, lambda p: (F.length(p) >= least) & F.contains(F.lower(c), F.lower(p)))
    out = F.lit(False)
    for p in needles:
        if len(p) >= least:
            out = out | F.contains(F.lower(c), F.lit(p.lower()))
    return out


def strip_delimiters(c: Column) -> Column:
    """An id that a provider echoed with quotes, brackets or a label around it."""
    return F.btrim(F.regexp_replace(F.trim(c), r"^(?i)(node_id|id)\s*[:=]\s*", ""), F.lit("<>[]\"'` "))


def is_symbol(c: Column) -> Column:
    return F.contains(c, F.lit("::"))


def is_identifier(c: Column) -> Column:
    return c.rlike("^[A-Za-z_][A-Za-z0-9_]*$")


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(c) / 4).cast("bigint")


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def short_hash(c: Column) -> Column:
    """The first 16 hexadecimal digits, as logs have it."""
    return F.substring(F.sha2(c, 256), 1, 16)


def config_hash(settings: Column) -> Column:
    """Of a map or struct: the same whatever the order of a map's keys."""
    return short_hash(F.to_json(settings))


def instant(c: Column) -> Column:
    """ISO text, also with a trailing Z or without a zone (UTC), as a timestamp; null where it isn't one."""
    return F.try_to_timestamp(F.regexp_replace(F.regexp_replace(c, "[Zz]$", "+00:00"), r"^([^+]*T[^+-]*)$", "$1+00:00"))


def shortened(c: Column, kind: str) -> Column:
    """Text cut to what a prompt or report has room for; see dims.CUT."""
    return F.substring(c, 1, dims.CUT[kind])


def is_indonesian(c: Column) -> Column:
    """Whether a request reads as Indonesian, by a few frequent words."""
    return contains_any(c, dims.INDONESIAN)


def chunk_type(title: Column) -> Column:
    has = lambda *w: contains_any(title, w)
    return F.when(has("non-functional", "non-fungsional", "kebutuhan non"), "NFR").when(has("functional requirement", "kebutuhan fungsional", "use case"), "FR").when(has("design", "architecture", "perancangan", "desain", "arsitektur"), "Design").otherwise("General")


def file_class(path: Column) -> Column:
    """Class of a source file by its path; null where it has none."""
    name = F.element_at(F.split(path, "/"), -1)
    under = lambda *p: F.startswith(path, F.lit(f"src/{'/'.join(p)}/"))
    tests = under("lib", "test") | under("lib", "db", "models", "__mocks__") | under("lib", "db", "repositories", "__tests__") | under("lib", "services", "__tests__") | under("lib", "utils", "__mocks__")
    app = F.when(name.rlike(r"^route\.tsx?$"), "API_ROUTE").when(name.rlike(r"^(page|layout)\.tsx?$"), "PAGE_COMPONENT")
    return (
        F.when(under("app"), app)
        .when(under("components") | under("hooks") | under("lib", "stores"), "UI_COMPONENT")
        .when(tests, None)
        .when(under("lib", "db", "models") | under("types"), "TYPE_DEFINITION")
        .when(under("lib"), "UTILITY")
    )


def route_path(path: Column) -> Column:
    """src/app/a/[id]/route.ts → /a/{id}; null elsewhere."""
    inner = F.regexp_replace(F.regexp_extract(path, "^src/app(.*)/[^/]*$", 1), r"\[([^\]]+)\]", "{$1}")
    return F.when(F.startswith(path, F.lit("src/app/")), F.when(inner == "", "/").otherwise(inner))


def source_path(path: Column) -> Column:
    """From the last src component on, else the file's name."""
    found = F.regexp_extract(path, "^(?:.*/)?(src/.*)$", 1)
    return F.when(found != "", found).otherwise(F.element_at(F.split(path, "/"), -1))


def severity(chain: Column) -> Column:
    """Severity of a causal chain by its last edge; seeds, with none, are high."""
    by = F.create_map(*[F.lit(x) for name, _, _, _, s, _ in dims.edge_rows() for x in (name, s)])
    return F.when(F.size(chain) == 0, dims.HIGH).otherwise(F.coalesce(by[F.element_at(chain, -1)], F.lit(dims.LOW)))


def severity_rank(s: Column) -> Column:
    return F.when(s == dims.HIGH, 0).when(s == dims.MEDIUM, 1).otherwise(2)


def scope(n: Column, local: int = 10, medium: int = 30) -> Column:
    return F.when(n <= local, "terlokalisasi").when(n <= medium, "menengah").otherwise("ekstensif")


def rank_bucket(rank: Column) -> Column:
    return F.when(rank.isNull(), "not in pool").when(rank <= 15, "1-15").when(rank <= 25, "16-25").when(rank <= 30, "26-30").otherwise(">30")


def layers_to_chunk_types(layers: Column) -> Column:
    """Requirement → FR and NFR, design → Design, code → General; each once, in order."""
    one = lambda x: F.when(x == "requirement", F.array(F.lit("FR"), F.lit("NFR"))).when(x == "design", F.array(F.lit("Design"))).when(x == "code", F.array(F.lit("General"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.transform(layers, one)))


def coherent_layers(change_type: Column, layers: Column) -> Column:
    """A deletion touches the code layer too; an addition to code alone touches its requirement."""
    one = lambda x: F.array(F.lit(x))
    alone = (F.size(layers) == 1) & F.array_contains(layers, "code")
    return F.when(change_type == "DELETION", F.array_union(layers, one("code"))).when((change_type == "ADDITION") & alone, F.array_union(layers, one("requirement"))).otherwise(layers)


def saturate(score: Column) -> Column:
    return score / (score + F.lit(1.0))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.lit(100.0) * part / whole)
