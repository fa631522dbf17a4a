"""Nodes, references and chunks from source files and Markdown; resolution of references by joins.

A bracket-aware scanner reads TypeScript: strings and comments are blanked,
declarations are found at the depth where they belong, and bodies are searched
for references. Targets are resolved afterwards, against the nodes of all files.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import text as X

BUILTIN = set("Array Boolean Buffer Date Error FormData Headers Intl JSON Map Math Number Object Promise Proxy Reflect RegExp Request Response Set String Symbol URL URLSearchParams WeakMap WeakSet clearInterval clearTimeout console document fetch globalThis parseFloat parseInt process require setInterval setTimeout window".split())
KEYWORDS = set("if for while switch catch return function await typeof new delete void super constructor import export async do else in of instanceof yield throw".split())
PRIMITIVE = set("any bigint boolean never null number object string symbol undefined unknown void".split())
HOOKS = ("useCallback", "useEffect", "useLayoutEffect", "useMemo")
HTTP = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")

_NOISE = re.compile(r"//[^\n]*|/\*.*?\*/|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`", re.S)


def blank(src: str) -> str:
    """Comments and the insides of strings as spaces, everything else in its place."""
    def sub(m: re.Match) -> str:
        t = m[0]
        hide = lambda s: re.sub(r"[^\n]", " ", s)
        return hide(t) if t[0] == "/" else t[0] + hide(t[1:-1]) + t[-1]

    return _NOISE.sub(sub, src)


def closing(code: str, at: int) -> int:
    """Index of the bracket that closes the one at `at`, or the end."""
    depth = 0
    for i in range(at, len(code)):
        if code[i] in "([{":
            depth += 1
        elif code[i] in ")]}":
            depth -= 1
            if not depth:
                return i
    return len(code) - 1


def depths(code: str) -> list[int]:
    out, d = [], 0
    for ch in code:
        if ch == "}":
            d -= 1
        out.append(d)
        if ch == "{":
            d += 1
    return out


_DECL = re.compile(r"(?P<export>\bexport\s+(?:default\s+)?)?(?:declare\s+)?(?:(?P<fn>(?:async\s+)?function\b\s*\*?\s*(?P<fname>\w+))|(?P<cls>(?:abstract\s+)?class\s+(?P<cname>\w+))|(?P<iface>interface\s+(?P<iname>\w+))|(?P<alias>type\s+(?P<aname>\w+)\s*(?:<[^=]*>)?\s*=)|(?P<enum>(?:const\s+)?enum\s+(?P<ename>\w+))|(?P<var>(?:const|let|var)\s+(?P<vname>\w+)\s*(?P<ann>:[^=]+?)?=(?!=)))")
_IMPORT = re.compile(r"\b(?:import|export)\s+(?P<what>[^;'\"]*?)\s*from\s*['\"]|\bimport\s*['\"]")
_ARROW = re.compile(r"\s*(?:async\s+)?(?:function\b\s*\*?\s*\w*\s*)?(?:<[^(]*>)?\s*(?:\(|\w+\s*=>)")


def _string_at(src: str, quote: int) -> str:
    end = src.find(src[quote], quote + 1)
    return src[quote + 1 : end if end >= 0 else len(src)]


def _jsdoc(src: str, at: int) -> str | None:
    m = re.search(r"/\*\*((?:(?!\*/).)*)\*/\s*$", src[:at], re.S)
    return " ".join(x.strip(" *") for x in m[1].split("\n")).strip() if m else None


def imports(src: str, code: str) -> tuple[list[str], dict[str, tuple[str, str]]]:
    """Specifiers of a file, and local name → (specifier, imported name)."""
    specs, names = [], {}
    for m in _IMPORT.finditer(code):
        spec = _string_at(src, m.end() - 1)
        specs.append(spec)
        what = re.sub(r"^type\s+", "", (m["what"] or "").strip())
        inner = re.search(r"\{(.*)\}", what, re.S)
        for part in (inner[1].split(",") if inner else ()):
            w = re.sub(r"^\s*type\s+", "", part).split()
            if w:
                names[w[-1]] = (spec, w[0])
        rest = re.sub(r"\{.*\}", "", what, flags=re.S)
        for part in rest.split(","):
            w = part.split()
            if len(w) == 3 and w[0] == "*":
                names[w[2]] = (spec, "*")
            elif len(w) == 1 and w[0] != "*":
                names[w[0]] = (spec, "default")
    return specs, names


def skeleton(body: str) -> str:
    """A body with what says little folded: comments gone, long strings, templates, arrays, objects and mark-up shortened."""
    out = re.sub(r"//[^\n]*|/\*.*?\*/", "", body, flags=re.S)
    out = re.sub(r"'[^'\n]{80,}'|\"[^\"\n]{80,}\"", "'…'", out)
    out = re.sub(r"`[^`]{100,}`", "`…`", out)
    out = re.sub(r"\[((?:[^\[\],]*,){3,}[^\[\]]*)\](?!\s*\))", "[…]", out)
    out = re.sub(r"\{((?:\s*\w+\s*:[^{},]*,){4,}[^{}]*)\}", "{…}", out)
    out = re.sub(r"<([A-Z]\w*)[^<>]*>(?:(?!</\1>).)*</\1>", r"<\1/>", out, flags=re.S)
    return re.sub(r"\n\s*\n+", "\n", out).strip()


def scan(path: str, src: str) -> tuple[list[dict], list[dict]]:
    """(nodes, references) of one file. A reference leads from source to a name of a specifier's file, or of its own file if that is null."""
    file = re.sub(r"^(?:.*/)?(src/.*)$", r"\1", path) if "src/" in path else path.rsplit("/", 1)[-1]
    code = blank(src)
    depth = depths(code)
    specs, names = imports(src, code)
    directive = re.match(r"\s*(?:/\*.*?\*/\s*|//[^\n]*\n\s*)*['\"]use (client|server)['\"]", src, re.S)
    nodes, refs = [], []
    exported_names = set(re.findall(r"\w+", " ".join(re.findall(r"\bexport\s*\{([^}]*)\}(?!\s*from)", code))))

    def node(kind: str, name: str, a: int, b: int, signature: str = "", doc: str | None = None, export: bool = False, own: str | None = None, logic: str | None = None) -> str:
        nid = own or f"{file}::{name}"
        nodes.append({"node_id": nid, "node_type": kind, "name": name, "file_path": None if kind == "ExternalPackage" else file, "line_start": src.count("\n", 0, a) + 1, "line_end": src.count("\n", 0, b) + 1, "signature": signature.strip()[:400], "docstring": doc, "source_code": src[a : b + 1], "internal_logic_abstraction": logic, "exported": export or name in exported_names, "client_directive": directive[1] if directive and kind == "File" else None})
        return nid

    def ref(source: str, kind: str, name: str, spec: str | None = None) -> None:
        refs.append({"source_id": source, "edge_type": kind, "file_path": file, "spec": spec, "name": name})

    def named(source: str, kind: str, name: str) -> None:
        spec, orig = names.get(name, (None, name))
        ref(source, kind, orig, spec)

    def types(source: str, text: str) -> None:
        for t in dict.fromkeys(re.findall(r"[A-Za-z_]\w*", text)):
            if t not in PRIMITIVE and t not in BUILTIN and t[0].isupper():
                named(source, "TYPED_BY", t)

    def body(source: str, a: int, b: int) -> None:
        c, s = code[a : b + 1], src[a : b + 1]
        for m in re.finditer(r"(?<![\w.])(\w+)((?:\.\w+)*)\s*(?:<[\w\s,\[\]]*>)?\(", c):
            root, tail = m[1], m[2]
            if root in KEYWORDS or root in BUILTIN or root.isdigit() or re.search(r"function\s*$", c[: m.start()]):
                continue
            if not tail:
                named(source, "CALLS", root)
            elif names.get(root, ("", ""))[1] == "*":
                ref(source, "CALLS", tail[1:].split(".")[0], names[root][0])
            elif root in names:
                ref(source, "CALLS", f"{names[root][1]}{tail}", names[root][0])
        for m in re.finditer(r"(?<![\w.])(\w+)\.(\w+)\b(?!\s*\()", c):
            if m[1] in names and names[m[1]][1] != "*":
                ref(source, "FIELDS_ACCESSED", f"{names[m[1]][1]}.{m[2]}", names[m[1]][0])
        for t in dict.fromkeys(re.findall(r"<([A-Z]\w*)[\s/>.]", c)):
            named(source, "RENDERS", t)
        for t in dict.fromkeys(re.findall(r"\bon[A-Z]\w*=\{(\w+)\}", c)):
            named(source, "PASSES_CALLBACK", t)
        for m in re.finditer(rf"\b(?:{'|'.join(HOOKS)})\s*\(", c):
            call = c[m.end() - 1 : closing(c, m.end() - 1) + 1]
            last = re.search(r"\[([^\[\]]*)\]\s*,?\s*\)$", call)
            for t in dict.fromkeys(re.findall(r"(?<![\w.])([A-Za-z_]\w*)", last[1] if last else "")):
                named(source, "HOOK_DEPENDS_ON", t)
        for m in re.finditer(r"\bimport\s*\(\s*['\"]", c):
            ref(source, "DYNAMIC_IMPORT", "", _string_at(s, m.end() - 1))
        for m in re.finditer(r"(?:\bfetch|\.(?:get|post|put|patch|delete))\s*(?:<[^>]*>)?\(\s*(['\"`])", c):
            url = _string_at(s, m.end() - 1)
            if url.startswith("/api/"):
                ref(source, "CLIENT_API_CALLS", re.sub(r"\$\{[^}]*\}", "*", url.split("?")[0]))
        for t in dict.fromkeys(re.findall(r":\s*([A-Z]\w*)", c) + re.findall(r"\bmodel\s*<\s*(\w+)", c)):
            if t not in BUILTIN:
                named(source, "TYPED_BY", t)
        for t in dict.fromkeys(re.findall(r"\bref:\s*['\"](\w+)['\"]", s)):
            ref(source, "TYPED_BY", t)

    nodes_at = node("File", file.rsplit("/", 1)[-1], 0, max(0, len(src) - 1), own=file)
    nodes[0]["source_code"] = None
    for spec in dict.fromkeys(specs):
        outside = not spec.startswith((".", "@/"))
        if outside:
            node("ExternalPackage", spec, 0, 0, own=f"ext::{spec}")
        ref(nodes_at, "DEPENDS_ON_EXTERNAL" if outside else "IMPORTS", "", spec)
    for m in re.finditer(r"\bimport\s*\(\s*['\"]", code):
        if depth[m.start()] == 0:
            ref(nodes_at, "DYNAMIC_IMPORT", "", _string_at(src, m.end() - 1))
    for m in _DECL.finditer(code):
        if depth[m.start()] != 0 or (m.start() and code[m.start() - 1] not in " \n\t;}"):
            continue
        export, doc, at = bool(m["export"]), _jsdoc(src, m.start()), m.end()
        own = None
        if m["fn"]:
            p = code.find("(", at)
            close = closing(code, p) if p >= 0 else at
            b = code.find("{", close)
            end = closing(code, b) if b >= 0 else len(code) - 1
            own = node("Function", m["fname"], m.start(), end, src[m.start() : b if b >= 0 else end], doc, export, logic=skeleton(src[b : end + 1]))
            types(own, code[p : b if b >= 0 else end])
            body(own, b if b >= 0 else end, end)
        elif m["cls"]:
            b = code.find("{", at)
            end = closing(code, b) if b >= 0 else len(code) - 1
            head = code[at:b]
            own = node("Class", m["cname"], m.start(), end, src[m.start() : b], doc, export)
            x = re.search(r"\bextends\s+([\w.]+)", head)
            if x:
                named(own, "INHERITS", x[1].split(".")[-1])
            x = re.search(r"\bimplements\s+(.*)$", head, re.S)
            for t in re.findall(r"\w+", re.sub(r"<[^>]*>", "", x[1])) if x else ():
                named(own, "IMPLEMENTS", t)
            for k in re.finditer(r"(?:(?:public|private|protected|static|async|override|get|set)\s+)*(?<![\w.])(\w+)\s*(?:<[^(]*>)?\(", code[b + 1 : end]):
                a = b + 1 + k.start()
                if depth[a] != 1 or k[1] in KEYWORDS - {"constructor"} or code[b + 1 : a].rstrip()[-1:] in ("=", ".", "("):
                    continue
                close = closing(code, b + k.end())
                open_ = re.compile(r"[^;{}]*\{").match(code, close + 1)
                if not open_:
                    continue
                stop = closing(code, open_.end() - 1)
                meth = node("Method", f"{m['cname']}.{k[1]}", a, stop, src[a : open_.end() - 1], _jsdoc(src, a), True, logic=skeleton(src[open_.end() - 1 : stop + 1]))
                ref(own, "DEFINES_METHOD", f"{m['cname']}.{k[1]}")
                types(meth, code[b + k.end() : open_.end()])
                body(meth, open_.end() - 1, stop)
        elif m["iface"] or m["alias"] or m["enum"]:
            kind, name = ("Interface", m["iname"]) if m["iface"] else ("TypeAlias", m["aname"]) if m["alias"] else ("Enum", m["ename"])
            b = code.find("{", at)
            stop = code.find(";", at)
            if m["alias"] and (b < 0 or (0 <= stop < b) or code[at:b].strip()):
                end = stop if stop >= 0 else len(code) - 1
                b = -1
            else:
                end = closing(code, b)
            own = node(kind, name, m.start(), end, src[m.start() : b if b >= 0 else end], doc, export)
            x = re.search(r"\bextends\s+([\w,\s]+)", code[at:b]) if m["iface"] and b >= 0 else None
            for t in re.findall(r"\w+", x[1]) if x else ():
                named(own, "INHERITS", t)
            for k in re.finditer(r"(?:readonly\s+)?(\w+)\??\s*(:)", code[b + 1 : end]) if b >= 0 and not m["enum"] else ():
                a = b + 1 + k.start()
                if depth[a] != 1 or code[b + 1 : a].rstrip()[-1:] not in ("", ";", ",", "}") and "\n" not in code[b + 1 : a][-len(code[b + 1 : a]) + len(code[b + 1 : a].rstrip()) :]:
                    continue
                line = min(x for x in (code.find(";", a), code.find("\n", a), end) if x >= 0)
                field = node("InterfaceField", f"{name}.{k[1]}", a, line, src[a:line], export=export)
                if kind == "Interface":
                    ref(own, "CONTAINS", f"{name}.{k[1]}")
                types(field, code[b + 1 + k.end() : line])
        else:
            is_fn = _ARROW.match(code, at)
            p = is_fn.end() - 1 if is_fn else -1
            arrow = bool(is_fn) and (code[p] == ">" or "=>" in code[closing(code, p) : closing(code, p) + 200].split("\n\n")[0].split(";")[0] or "function" in is_fn[0]) if is_fn else False
            stop = at
            while stop < len(code) and not (code[stop] == ";" or code[stop] == "\n" and code[at:stop].strip() and not code[stop:].lstrip().startswith((".", "=>", "?", ":"))):
                stop = closing(code, stop) + 1 if code[stop] in "([{" else stop + 1
            end = min(stop, len(code) - 1)
            if arrow:
                cut = code.find("=>", at)
                own = node("Function", m["vname"], m.start(), end, src[m.start() : cut if 0 <= cut < end else end], doc, export, logic=skeleton(src[at : end + 1]))
                types(own, (m["ann"] or "") + code[at : cut if cut >= 0 else at])
                body(own, cut + 2 if 0 <= cut < end else at, end)
            elif re.match(r"\s*(?:new\b|[\[{]|[\w.]+\s*(?:<[^>]*>)?\()", code[at:]):
                keys = re.findall(r"(?<![\w.])(\w+)\s*:", code[at : end + 1])
                own = node("Variable", m["vname"], m.start(), end, f"const {m['vname']} = {{{', '.join(dict.fromkeys(keys))}}}", doc, export)
                types(own, m["ann"] or "")
                body(own, at, end)
        if own:
            ref(nodes_at, "CONTAINS", own[len(file) + 2 :])
    if file.endswith("middleware.ts"):
        m = re.search(r"\bmatcher\s*:\s*(\[[^\]]*\]|['\"][^'\"]*['\"])", src)
        for p in re.findall(r"['\"](/[^'\"]*)['\"]", m[1]) if m else ():
            ref(nodes_at, "CALLS", "route:" + re.sub(r"/:\w+\*$|\(\.\*\)$", "*", p))
    return nodes, refs


NODE = "node_id string, node_type string, name string, file_path string, line_start int, line_end int, signature string, docstring string, source_code string, internal_logic_abstraction string, exported boolean, client_directive string"
REF = "source_id string, edge_type string, file_path string, spec string, name string"


#: of a scan: nodes and references in one table
SCAN = f"{NODE}, source_id string, edge_type string, spec string"


def spread(rows: DataFrame, key: str, tasks_a_core: int = 4) -> DataFrame:
    """Rows over all cores by key: what is expensive for each row shouldn't hang on how few files or row groups a table came in."""
    return rows.repartition(tasks_a_core * rows.sparkSession.sparkContext.defaultParallelism, key)


def scanned(files: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Nodes and references (edge_type isn't null) of files (path, content), which are read once, by all cores; of the columns of SCAN those asked for."""
    schema = ", ".join(c for c in SCAN.split(", ") if not columns or c.split()[0] in columns)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                part = whole.slice(at, 500)
                rows = [r for p, s in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if p is not None and s is not None for found in scan(p, s) for r in found]
                yield pa.RecordBatch.from_pylist(rows, arrow)

    return spread(files.select("path", F.col("content").cast("string").alias("content")), "path").mapInArrow(run, schema)


def nodes(files: DataFrame, written=lambda df: df) -> DataFrame:
    """Nodes of files (path, content), with class, route and embedding text; external packages once for all files. written keeps what the scan gives, so that there is one."""
    return classified(written(scanned(files, [c.split()[0] for c in NODE.split(", ")] + ["edge_type"]).where("edge_type IS NULL").drop("edge_type")))


def classified(x: DataFrame) -> DataFrame:
    x = x.where("node_type <> 'ExternalPackage'").unionByName(x.where("node_type = 'ExternalPackage'").dropDuplicates(["node_id"]))
    kind = F.when(~F.col("node_type").isin("Enum", "Interface", "InterfaceField", "TypeAlias", "ExternalPackage"), X.file_class(F.col("file_path")))
    route = F.when(kind.isin("API_ROUTE", "PAGE_COMPONENT"), X.route_path(F.col("file_path")))
    x = x.withColumn("file_classification", kind).withColumn("route_path", route)
    return x.withColumn("embed_text", embed_text()) if "docstring" in x.columns else x


def embed_text():
    return F.coalesce(F.nullif(F.concat_ws("\n", F.nullif("docstring", F.lit("")), F.nullif("signature", F.lit(""))), F.lit("")), X.readable_name(F.col("name")))


def references(files: DataFrame) -> DataFrame:
    return scanned(files, [c.split()[0] for c in REF.split(", ")]).where("edge_type IS NOT NULL").select(*[c.split()[0] for c in REF.split(", ")])


def resolve_imports(refs: DataFrame, files: DataFrame) -> DataFrame:
    """refs (file_path, spec, …) with target: the file that a relative or @/ specifier means, by probing five endings in order; others drop out."""
    here = F.regexp_extract("file_path", "^(.*)/[^/]*$", 1)
    raw = F.when(F.startswith("spec", F.lit("@/")), F.concat(F.lit("src/"), F.substring("spec", 3, 10000))).when(F.startswith("spec", F.lit(".")), F.concat_ws("/", here, "spec"))
    # a/./b and a/b/.. in order of their parts
    fold = F.aggregate(F.split(raw, "/"), F.array().cast("array<string>"), lambda a, x: F.when(x.isin(".", ""), a).when((x == "..") & (F.size(a) > 0), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))))
    ends = F.array(*[F.struct(F.lit(i).alias("o"), F.lit(e).alias("e")) for i, e in enumerate(("", ".ts", ".tsx", "/index.ts", "/index.tsx"))])
    keys = refs.select("file_path", "spec").distinct()
    probes = keys.withColumn("_base", F.array_join(fold, "/")).where("_base <> ''").select("file_path", "spec", "_base", F.explode(ends).alias("_p"))
    found = probes.select("file_path", "spec", "_p.o", F.concat("_base", "_p.e").alias("target")).join(files.select(F.col("file_path").alias("target")).distinct(), "target")
    first = found.groupBy("file_path", "spec").agg(F.min_by("target", "o").alias("target"))
    return refs.join(first, ["file_path", "spec"])


def edges(files: DataFrame, known: DataFrame | None = None, written=lambda df: df) -> DataFrame:
    """(source_id, target_id, edge_type) of files (path, content), all targets among their nodes and those known of other files. written keeps what the scan gives, so that there is one."""
    own = ["node_id", "node_type", "name", "file_path", "exported"]
    extra = [c.split()[0] for c in NODE.split(", ")] if known is not None else own  # of nodes that are known more may be asked
    x = written(scanned(files, [*extra, "source_id", "edge_type", "spec"]))
    n, r = classified(x.where("edge_type IS NULL").select(*extra)), x.where("edge_type IS NOT NULL").select("source_id", "edge_type", "file_path", "spec", "name")
    if known is not None:
        n = n.select(*known.columns).unionByName(known.join(n.select("node_id"), "node_id", "left_anti"))
    ids = n.select(F.col("node_id").alias("target_id"))
    own_files = n.where("node_type = 'File'").select("file_path")
    routed = n.where("file_classification = 'API_ROUTE'").select("file_path", "node_id", "node_type", "name", "route_path")
    local = r.where("spec IS NULL AND edge_type <> 'CLIENT_API_CALLS' AND NOT startswith(name, 'route:')").withColumn("target", F.col("file_path"))
    inside = resolve_imports(r.where("spec IS NOT NULL"), own_files)
    at = F.when((F.col("name") == "") | F.col("edge_type").isin("IMPORTS", "DYNAMIC_IMPORT"), F.col("target")).otherwise(F.concat_ws("::", "target", "name"))
    by_name = local.unionByName(inside.select(*local.columns)).select("source_id", "edge_type", at.alias("target_id"))
    # a default import means the file's only exported symbol, if there is one
    single = n.where("exported AND node_type IN ('Function', 'Class', 'Variable')").groupBy("file_path").agg(F.count("*").alias("k"), F.min("node_id").alias("node")).where("k = 1")
    default = inside.where("name = 'default'").join(single.select(F.col("file_path").alias("target"), "node"), "target").select("source_id", "edge_type", F.col("node").alias("target_id"))
    outside = r.where("edge_type = 'DEPENDS_ON_EXTERNAL'").select("source_id", "edge_type", F.concat(F.lit("ext::"), "spec").alias("target_id"))
    # calls of routes: the fewest wildcards win, and lead to the route's HTTP functions, else to its file
    calls = r.where("edge_type = 'CLIENT_API_CALLS'").select("source_id", "name")
    hit = match_routes(calls.select("name").distinct(), routed.select(F.col("route_path").alias("route")).distinct(), "name", "name")
    targets = routed.groupBy("route_path").agg(F.collect_list(F.when(F.col("node_type").eqNullSafe("Function") & F.col("name").isin(*HTTP), F.col("node_id"))).alias("fn"), F.collect_list(F.when(F.col("node_type") == "File", F.col("node_id"))).alias("file"))
    api = calls.join(hit, "name").join(targets, F.col("route") == F.col("route_path")).select("source_id", F.lit("CLIENT_API_CALLS").alias("edge_type"), F.explode(F.when(F.size("fn") > 0, F.col("fn")).otherwise(F.col("file"))).alias("target_id"))
    guard = r.where("startswith(name, 'route:')").select("source_id", F.substring("name", 7, 10000).alias("p"))
    prefix = F.regexp_replace("p", r"/?\*$", "")
    open_end = F.endswith("p", F.lit("*"))
    guarded = guard.join(routed.where("node_type = 'File'"), (F.col("route_path") == prefix) | (open_end & F.startswith("route_path", F.concat(prefix, F.lit("/"))))).select("source_id", F.lit("CALLS").alias("edge_type"), F.col("node_id").alias("target_id"))
    every = by_name.unionByName(default).unionByName(outside).unionByName(api).unionByName(guarded)
    return every.where("source_id <> target_id").join(ids, "target_id", "left_semi").select("source_id", "target_id", "edge_type").distinct()


def match_routes(urls: DataFrame, routes: DataFrame, key: str, path: str) -> DataFrame:
    """(key, route): the route of most literal segments that fits the path segment by segment; {x} or [x] fits any, and so does * in the path.

    Joined on the number of segments, so only routes of the same length meet.
    """
    seg = lambda c: F.filter(F.split(c, "/"), lambda x: x != "")
    wild = lambda x: x.rlike(r"^[\[{]")
    u = urls.select(F.col(key).alias("_k"), seg(F.col(path)).alias("_u")).withColumn("_n", F.size("_u"))
    r = routes.select("route", seg(F.col("route")).alias("_r")).withColumn("_n", F.size("_r")).withColumn("_w", F.size(F.filter("_r", wild)))
    fits = F.forall(F.zip_with("_u", "_r", lambda a, b: wild(b) | (a == b) | (a == "*")), lambda ok: ok)
    w = Window.partitionBy("_k").orderBy("_w", "route")
    return u.join(r, "_n").where(fits).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select(F.col("_k").alias(key), "route")


def chunks(files: DataFrame) -> DataFrame:
    """(chunk_id, source_file, section_title, chunk_type, text) of Markdown files (path, text).

    Sections begin at headings of the second and third level, outside code
    fences; what comes before the first one drops out, deeper ones belong to
    their section. A file without any is one chunk. Equal titles of a file get
    ordinals.
    """
    schema = "source_file string, stem string, pos int, section_title string, text string"

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for path, text in zip(pdf["path"], pdf["text"]):
                if path is None or text is None:
                    continue
                stem, found, fence, lines = path.rsplit("/", 1)[-1].rsplit(".", 1)[0], [], False, text.split("\n")
                for i, line in enumerate(lines):
                    fence ^= line.lstrip().startswith(("```", "~~~"))
                    m = None if fence else re.match(r"#{2,3}\s+(.*?)\s*#*\s*$", line)
                    if not fence and not m and i and re.fullmatch(r"-{3,}\s*", line) and lines[i - 1].strip() and not lines[i - 1].startswith(("#", "-", "|")):
                        found.append((i - 1, i + 1, lines[i - 1].strip()))  # a title with a line of dashes below
                    elif m:
                        found.append((i, i + 1, re.sub(r"[*_`]|\[([^\]]*)\]\([^)]*\)", r"\1", m[1])))
                if not found:
                    rows.append((path, stem, 0, "document", text.strip()))
                for k, (_, b, title) in enumerate(found):
                    end = found[k + 1][0] if k + 1 < len(found) else len(lines)
                    rows.append((path, stem, k, title, "\n".join(lines[b:end]).strip()))
            yield pd.DataFrame(rows, columns=["source_file", "stem", "pos", "section_title", "text"])

    x = files.select("path", "text").mapInPandas(run, schema)
    slug = X.slugify(F.col("section_title"))
    nth = F.row_number().over(Window.partitionBy("source_file", slug).orderBy("pos"))
    cid = F.concat(F.col("stem"), F.lit("__"), slug, F.when(nth > 1, F.concat(F.lit("_"), nth.cast("string"))).otherwise(""))
    return x.select(cid.alias("chunk_id"), "source_file", "section_title", X.chunk_type(F.col("section_title")).alias("chunk_type"), "text")
