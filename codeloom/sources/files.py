"""Source trees, manifests, transcripts and Python files as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: File suffixes and the language that each is read as.
SUFFIXES = {
    ".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".jsx": "javascript", ".vue": "typescript", ".java": "java",
}
NODE = "struct<qname:string,kind:string,start_line:int,end_line:int,signature:string,parent:string,decorators:array<string>>"
CALL = "struct<source:string,receiver:string,name:string,form:string,line:int>"
IMPORT = "struct<local:string,target_module:string,target_name:string,is_star:boolean,ord:int>"
BASE = "struct<cls:string,base:string>"
TYPE = "struct<scope:string,receiver:string,type:string>"


def read_tree(spark: SparkSession, path: str, suffixes: tuple[str, ...] = tuple(SUFFIXES)) -> DataFrame:
    """path (relative), content, size, hash of the files below a folder that have a known suffix."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = path.rstrip("/").split(":", 1)[-1].replace("//", "/")
    rel = F.regexp_replace("path", "^[a-z]*:/*" + root.replace("+", r"\+").lstrip("/") + "/", "")
    f = files.select(rel.alias("path"), F.decode("content", "UTF-8").alias("content"), F.col("length").alias("size"), F.sha2("content", 256).alias("hash"),
                     F.unix_millis("modificationTime").cast("double").alias("stamp"))
    return f.where(F.regexp_extract("path", r"(\.[a-z]+)$", 1).isin(list(suffixes)))


def language(path: Column) -> Column:
    """The language of a path by its suffix; null if unknown."""
    pairs = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])
    return F.try_element_at(pairs, F.regexp_extract(path, r"(\.[a-z]+)$", 1))


def module_of(path: Column) -> Column:
    """The module of a Python path: dots for slashes, without a leading src and a trailing __init__."""
    m = F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), "/", ".")
    return F.regexp_replace(F.regexp_replace(m, r"^src\.", ""), r"\.__init__$", "")


def vue_script(content: Column) -> Column:
    """The script blocks of a Vue file, joined."""
    return F.array_join(F.regexp_extract_all(content, F.lit(r"(?s)<script[^>]*>(.*?)</script>"), F.lit(1)), "\n")


def parse_python(files: DataFrame) -> DataFrame:
    """path, module, ok and arrays of nodes, calls, imports, bases, types and names, for files(path, content, module); a file that doesn't parse is not ok and empty.

    types are the declared types that are a plain name: parameters without a default, annotated names right in a module's or function's body, and, for
    methods, annotated fields of their class as self.<field>. names is what a literal `__all__` lists, null without one. Calls of super itself are left out.
    Each file is parsed alone in its task by the standard library's syntax tree; duplicates of a name keep the first.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ast

        def one(path: str, module: str, content: str) -> dict:
            nodes, calls, imports, bases, types, names, seen = [], [], [], [], [], None, set()

            def annotated(body):
                found = {}
                for x in body:
                    if isinstance(x, ast.AnnAssign) and isinstance(x.target, ast.Name) and isinstance(x.annotation, ast.Name):
                        found.setdefault(x.target.id, x.annotation.id)
                return found

            def declare(node, scope, fields):
                """Types of a function's parameters and body; fields are those of the class around."""
                a = node.args
                plain = [*a.posonlyargs, *a.args]
                plain = plain[: len(plain) - len(a.defaults)] + [k for k, d in zip(a.kwonlyargs, a.kw_defaults, strict=True) if d is None]
                found = dict(fields) | {x.arg: x.annotation.id for x in plain if isinstance(x.annotation, ast.Name)}
                for k, v in annotated(node.body).items():
                    found.setdefault(k, v)
                types.extend({"scope": scope, "receiver": k, "type": v} for k, v in found.items())

            def add(qname, kind, node, parent, signature, decorators):
                if qname not in seen:
                    seen.add(qname)
                    nodes.append({"qname": qname, "kind": kind, "start_line": getattr(node, "lineno", 1), "end_line": getattr(node, "end_lineno", 1) or 1,
                                  "signature": signature, "parent": parent, "decorators": decorators})

            def walk(node, scope, in_class):
                for child in ast.iter_child_nodes(node):
                    if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                        name = f"{scope}.{child.name}" if "::" in scope else f"{scope}::{child.name}"
                        is_class = isinstance(child, ast.ClassDef)
                        decorators = [ast.unparse(d.func if isinstance(d, ast.Call) else d) for d in child.decorator_list]
                        text = child.name if is_class else f"{child.name}({ast.unparse(child.args)})"
                        add(name, "class" if is_class else "method" if in_class else "function", child, scope, text, decorators)
                        if is_class:
                            bases.extend({"cls": name, "base": ast.unparse(b)} for b in child.bases)
                        else:
                            declare(child, name, {f"self.{k}": v for k, v in annotated(node.body).items()} if in_class else {})
                        walk(child, name, is_class)
                        continue
                    if isinstance(child, ast.Call) and not (isinstance(child.func, ast.Name) and child.func.id == "super"):
                        f = child.func
                        simple, attribute = isinstance(f, ast.Name), isinstance(f, ast.Attribute)
                        calls.append({"source": scope, "receiver": ast.unparse(f.value) if attribute else None,
                                      "name": f.id if simple else f.attr if attribute else ast.unparse(f),
                                      "form": "simple" if simple else "attribute" if attribute else "other", "line": child.lineno})
                    elif isinstance(child, ast.Import):
                        for a in child.names:
                            imports.append({"local": a.asname or a.name.split(".")[0], "target_module": a.name, "target_name": None, "is_star": False, "ord": len(imports)})
                    elif isinstance(child, ast.ImportFrom):
                        up = module.split(".")[: len(module.split(".")) - child.level] if child.level else []
                        target = ".".join([*up, *([child.module] if child.module else [])])
                        for a in child.names:
                            imports.append({"local": a.asname or a.name, "target_module": target, "target_name": a.name, "is_star": a.name == "*", "ord": len(imports)})
                    walk(child, scope, in_class)

            try:
                tree = ast.parse(content or "")
                add(module, "module", tree, None, module, [])
                nodes[0]["end_line"] = (content or "").count("\n") + 1
                walk(tree, module, False)
                types.extend({"scope": module, "receiver": k, "type": v} for k, v in annotated(tree.body).items())
                for x in tree.body:
                    if isinstance(x, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in x.targets):
                        items = x.value.elts if isinstance(x.value, (ast.List, ast.Tuple, ast.Set)) else [None]
                        literal = all(isinstance(i, ast.Constant) and isinstance(i.value, str) for i in items)
                        names = [i.value for i in items] if literal else None
                        break
                ok = True
            except (SyntaxError, ValueError, RecursionError):
                nodes, calls, imports, bases, types, names, ok = [], [], [], [], [], None, False
            return {"path": path, "module": module, "ok": ok, "nodes": nodes, "calls": calls, "imports": imports, "bases": bases, "types": types, "names": names}

        for pdf in batches:
            yield pd.DataFrame([one(p, m, c) for p, m, c in zip(pdf["path"], pdf["module"], pdf["content"], strict=True)])

    return files.select("path", "module", "content").mapInPandas(
        run, f"path string, module string, ok boolean, nodes array<{NODE}>, calls array<{CALL}>, imports array<{IMPORT}>, bases array<{BASE}>, types array<{TYPE}>, names array<string>"
    )


def exploded(parsed: DataFrame, part: str) -> DataFrame:
    """One row per entry of an array of parse_python, with path and module."""
    return parsed.select("path", "module", F.explode(part).alias("x")).select("path", "module", "x.*")


def listed(parsed: DataFrame) -> DataFrame:
    """module, names of the modules that state which names a star import shows."""
    return parsed.where("names IS NOT NULL").select("module", "names")


def index_input(parsed: DataFrame) -> dict[str, DataFrame]:
    """The tables of parse_python that an index is built from."""
    return {k: exploded(parsed, k) for k in ("nodes", "calls", "imports", "bases", "types")} | {"listed": listed(parsed)}


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """run, ord, kind, text of JSON-lines transcripts; malformed lines are skipped; a file is a run and byte order its order."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("run"), F.posexplode(F.split("value", "\n")).alias("ord", "line"))
    j = t.select("run", F.col("ord").cast("long").alias("ord"), F.from_json("line", "type string, result string, text string").alias("j")).where("j.type IS NOT NULL")
    return j.select("run", "ord", F.col("j.type").alias("kind"), F.coalesce("j.result", "j.text").alias("text"))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """case_id, file, start, end of benchmark manifests, which are JSON arrays; a malformed file is an error."""
    cases = spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(
        "id string, repo string, base_commit string, changed_ranges map<string,array<array<int>>>, gold_files array<string>"
    ).json(path)
    return cases.select("id", F.explode("changed_ranges").alias("file", "ranges")).select("id", "file", F.explode("ranges").alias("r")).select(
        F.col("id").alias("case_id"), "file", F.col("r")[0].alias("start"), F.col("r")[1].alias("end")
    )
