"""Reading graph documents, fragments, configurations and files."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vertexloom.functions import text
from vertexloom.graph import PropertyGraph, conform
from vertexloom.schema import EDGE_COLUMNS, HYPEREDGE_COLUMNS, NODE_COLUMNS
from vertexloom.sources import code

_FIELDS = "array<map<string,string>>"


def _rows(documents: DataFrame, names: tuple[str, ...], columns: dict[str, str], aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    items = F.coalesce(*[F.from_json(F.get_json_object("value", f"$.{n}"), _FIELDS) for n in names], F.array().cast(_FIELDS))
    # items come out in their order, so one number a row is their place, however many documents and partitions there are
    spread = documents.select(F.explode(items).alias("m")).withColumn("__place", F.monotonically_increasing_id())
    values = []
    for name, kind in columns.items():
        if name == "ord":
            values.append(F.col("__place").alias("ord"))
        else:
            found = F.coalesce(*[F.element_at("m", a) for a in (*aliases.get(name, ()), name)])
            values.append((F.from_json(found, "array<string>") if kind == "array<string>" else found.try_cast(kind)).alias(name))
    return spread.select(*values)


def graph_documents(documents: DataFrame) -> PropertyGraph:
    """Node-link documents, one in each row's `value`: nodes, links or edges, hyperedges; older names of fields are folded.

    Stored direction is that of _src and _tgt where they are given. What isn't JSON gives no rows.
    """
    nodes = _rows(documents, ("nodes",), NODE_COLUMNS, {"label": ("label", "name"), "source_file": ("source_file", "path")})
    edges = _rows(documents, ("links", "edges"), EDGE_COLUMNS, {"src": ("_src", "source", "from"), "dst": ("_tgt", "target", "to"), "relation": ("relation", "type")})
    hyper = _rows(documents, ("hyperedges",), HYPEREDGE_COLUMNS, {"nodes": ("nodes", "members", "node_ids")})
    nodes = nodes.withColumn("norm_label", F.coalesce("norm_label", F.lower(F.coalesce("label", "id"))))
    return PropertyGraph(nodes.where("id is not null"), edges.where("src is not null and dst is not null and relation is not null"), hyper.where("size(nodes) > 0"))


def read_graph_json(spark: SparkSession, path: str) -> PropertyGraph:
    """Documents of whole files; for graphs beyond a file, use read_tables."""
    return graph_documents(spark.read.text(path, wholetext=True))


def read_tables(spark: SparkSession, path: str) -> PropertyGraph:
    """A graph that sinks.write_tables wrote."""
    return PropertyGraph(conform(spark.read.parquet(f"{path}/nodes"), NODE_COLUMNS), conform(spark.read.parquet(f"{path}/edges"), EDGE_COLUMNS))


def fragment_tokens(documents: DataFrame) -> DataFrame:
    """One row: the sums of input_tokens and output_tokens over extraction fragments."""
    one = lambda n: F.coalesce(F.sum(F.get_json_object("value", f"$.{n}").try_cast("long")), F.lit(0)).alias(n)
    return documents.agg(one("input_tokens"), one("output_tokens"))


def server_configs(documents: DataFrame) -> DataFrame:
    """(server, kind, value): command packages and required environment of configured servers; values of variables aren't kept."""
    servers = F.from_json(F.get_json_object("value", "$.mcpServers"), "map<string,struct<command:string,args:array<string>,env:map<string,string>>>")
    rows = documents.select(F.explode(servers).alias("server", "s"))
    package = F.element_at(F.filter("s.args", lambda a: ~F.startswith(a, F.lit("-"))), 1)
    parts = F.concat(F.array(F.struct(F.lit("command").alias("kind"), F.col("s.command").alias("value")), F.struct(F.lit("package").alias("kind"), F.when(F.size("s.args") > 0, package).alias("value"))), F.transform(F.coalesce(F.map_keys("s.env"), F.array().cast("array<string>")), lambda k: F.struct(F.lit("env").alias("kind"), k.alias("value"))))
    return rows.select("server", F.inline(parts)).where("value is not null")


def url_kind(url):
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/:?#]+)", 1))
    path = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1))
    return (
        F.when(host.rlike(r"(^|\.)(twitter|x)\.com$"), "tweet").when(host.rlike(r"(^|\.)arxiv\.org$"), "arxiv").when(host.rlike(r"(^|\.)github\.com$"), "github")
        .when(host.rlike(r"(^|\.)(youtube\.com|youtu\.be)$"), "youtube").when(path.rlike(r"\.pdf$"), "pdf").when(path.rlike(r"\.(png|jpe?g|gif|webp|svg)$"), "image").otherwise("webpage")
    )


def html_text(html):
    """Visible text: scripts, styles, comments and tags as spaces, runs of white space as one."""
    bare = F.regexp_replace(html, r"(?s)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->|<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def ingest_pages(pages: DataFrame) -> DataFrame:
    """(page_id, kind, host, title, n_words) of fetched pages."""
    words = html_text(F.coalesce("html", F.lit("")))
    return pages.select(
        "page_id", url_kind(F.coalesce("url", F.lit(""))).alias("kind"), F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z]+://([^/:?#]+)", 1)).alias("host"),
        F.regexp_extract(F.coalesce("html", F.lit("")), r"<title>([^<]*)</title>", 1).alias("title"), F.when(words == "", 0).otherwise(F.size(F.split(words, " "))).cast("long").alias("n_words"),
    )


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, category, n_words, sha256) of the files below a folder, read in place."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    body = F.decode("content", "UTF-8")
    words = F.size(F.filter(F.split(body, r"\s+"), lambda w: w != ""))
    return files.select("path", text.file_category(F.col("path")).alias("category"), words.cast("long").alias("n_words"), F.sha2("content", 256).alias("sha256"))


def changed_files(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """(path, change): new, changed, unchanged or deleted by content digest (path, sha256)."""
    joined = manifest.select("path", F.col("sha256").alias("old")).join(current.select("path", F.col("sha256").alias("new")), "path", "full")
    change = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "deleted").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")
    return joined.select("path", change.alias("change"))


def _ignore_regex(pattern: str) -> str:
    body = pattern.strip("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(body[i], re.escape(body[i]))
            i += 1
    anchored = "/" in pattern.rstrip("/")
    return ("^" if anchored else "^(?:.*/)?") + out + ("/.*$" if pattern.endswith("/") else "(?:/.*)?$")


def not_ignored(paths: DataFrame, rules: list[str]) -> DataFrame:
    """Paths that the rules let pass: globs with anchors and **, ! brings a path back, the last rule that matches decides."""
    hidden = F.lit(False)
    for rule in rules:
        if rule and not rule.startswith("#"):
            keep = rule.startswith("!")
            hidden = F.when(F.col("path").rlike(_ignore_regex(rule[keep:])), not keep).otherwise(hidden)
    return paths.where(~hidden)


def slice_texts(docs: DataFrame, most: int, id_col: str = "doc_id") -> DataFrame:
    """(id, piece, start, piece_text): whole texts in runs of whole lines of at most `most` characters; a longer line is cut evenly.

    Lines fall into pieces by the offset of their start, so a row's pieces need no state.
    """
    body = F.coalesce("text", F.lit(""))
    cuts = F.when(F.length(body) > 0, F.sequence(F.lit(0), F.floor((F.length(body) - 1) / most).cast("int"))).otherwise(F.array(F.lit(0)))

    def edge(k):
        """Place of cut k: after the last line feed of the `most` characters before k * most, else k * most itself."""
        back = F.locate("\n", F.reverse(F.substring(body, (k - 1) * most + 1, F.lit(most))))
        return F.when(k <= 0, 0).when(k * most >= F.length(body), F.length(body)).when(back > 0, k * most - back + 1).otherwise(k * most)

    spread = docs.select(id_col, F.explode(F.transform(cuts, lambda k: F.struct(k.alias("piece"), edge(k).alias("start"), edge(k + 1).alias("stop")))).alias("p"), body.alias("__text"))
    return spread.select(id_col, "p.piece", "p.start", F.substring("__text", F.col("p.start") + 1, F.col("p.stop") - F.col("p.start")).alias("piece_text"))


def pack_chunks(files: DataFrame, budget: int) -> DataFrame:
    """(path, directory, chunk): files of a directory (path, tokens) in path order, cut where the running sum passes a multiple of the budget."""
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    before = F.sum("tokens").over(Window.partitionBy("directory").orderBy("path").rowsBetween(Window.unboundedPreceding, -1))
    return files.withColumn("directory", folder).withColumn("chunk", F.floor(F.coalesce(before, F.lit(0)) / budget).cast("long")).select("path", "directory", "chunk")


_IDENT = r'(?:"[^"]+"|`[^`]+`|\[[^\]]+\]|[\w.]+)'


def _clean(name: str) -> str:
    return re.sub(r'["`\[\]]', "", name).lower()


def ddl_edges(sql: str) -> list[tuple[str, str, str]]:
    """(src, relation, dst) of a script's tables, views, functions, triggers and indexes; names of common table expressions are no tables."""
    body = re.sub(r"--[^\n]*|/\*.*?\*/", " ", sql or "", flags=re.S)
    out: list[tuple[str, str, str]] = []
    for m in re.finditer(rf"create\s+(?:temp(?:orary)?\s+)?table\s+(?:if\s+not\s+exists\s+)?({_IDENT})\s*\((.*?)\)\s*(?:;|$)", body, re.I | re.S):
        out.append(("script", "contains", _clean(m[1])))
        out += [(_clean(m[1]), "references", _clean(r[1])) for r in re.finditer(rf"references\s+({_IDENT})", m[2], re.I)]
    for m in re.finditer(rf"alter\s+table\s+(?:only\s+)?({_IDENT})[^;]*?references\s+({_IDENT})", body, re.I | re.S):
        out.append((_clean(m[1]), "references", _clean(m[2])))
    for m in re.finditer(rf"create\s+(?:or\s+replace\s+)?(?:materialized\s+)?view\s+({_IDENT})\s+as\s+(.*?)(?:;|$)", body, re.I | re.S):
        out.append(("script", "contains", _clean(m[1])))
        local = {_clean(c) for c in re.findall(rf"(?:with|,)\s+(?:recursive\s+)?({_IDENT})\s*(?:\([^)]*\))?\s+as\s*\(", m[2], re.I)}
        out += [(_clean(m[1]), "reads_from", t) for t in dict.fromkeys(_clean(x) for x in re.findall(rf"(?:from|join)\s+({_IDENT})", m[2], re.I)) if t not in local]
    for m in re.finditer(rf"create\s+(?:or\s+replace\s+)?(?:function|procedure)\s+({_IDENT})(.*?)(?=create\s+(?:or\s+replace\s+)?(?:function|procedure|table|view|trigger|index)\b|\Z)", body, re.I | re.S):
        out.append(("script", "contains", _clean(m[1])))
        written = re.findall(rf"\b(?:insert\s+into|update|delete\s+from|merge\s+into|truncate(?:\s+table)?)\s+(?:only\s+)?({_IDENT})", m[2], re.I)
        out += [(_clean(m[1]), "writes_to", t) for t in dict.fromkeys(map(_clean, written)) if t not in ("set", "of", "on")]
    for m in re.finditer(rf"create\s+trigger\s+({_IDENT}).*?\son\s+({_IDENT}).*?execute\s+(?:function|procedure)\s+({_IDENT})", body, re.I | re.S):
        out += [(_clean(m[1]), "triggers", _clean(m[2])), (_clean(m[1]), "executes", _clean(m[3]))]
    for m in re.finditer(rf"create\s+(?:unique\s+)?index\s+({_IDENT})\s+on\s+({_IDENT})", body, re.I):
        out.append((_clean(m[1]), "indexes", _clean(m[2])))
    return list(dict.fromkeys(out))


def markdown_edges(body: str) -> list[tuple[str, str, str]]:
    """(src, relation, dst): headings under headings, and links and back-quoted names under the heading they stand below."""
    out, stack = [], [(0, "document")]
    for line in (body or "").splitlines():
        if m := re.match(r"(#{1,6})\s+(.*?)\s*#*$", line):
            while stack[-1][0] >= len(m[1]):
                stack.pop()
            out.append((stack[-1][1], "contains", m[2]))
            stack.append((len(m[1]), m[2]))
        else:
            out += [(stack[-1][1], "references", t) for t in re.findall(r"\[[^\]]*\]\(([^)\s]+)", line)]
            out += [(stack[-1][1], "mentions", t) for t in re.findall(r"`([^`]+)`", line)]
    return list(dict.fromkeys(out))


def manifest_edges(body: str) -> list[tuple[str, str, str]]:
    """(src, relation, dst) of a package manifest: a JSON one's dependencies, or a TOML one's [*dependencies] tables."""
    body = (body or "").strip()
    if body.startswith("{"):
        try:
            found = json.loads(body)
        except ValueError:
            return []
        name = str(found.get("name", "package"))
        return [(name, "depends_on", d) for k in ("dependencies", "devDependencies", "peerDependencies") for d in sorted(found.get(k) or {})]
    out, section, name = [], "", "package"
    for line in body.splitlines():
        if m := re.match(r"\[+([^\]]+)\]+", line.strip()):
            section = m[1]
            if m := re.match(r"(?:.*\.)?dependencies\.(.+)", section):
                out.append((name, "depends_on", m[1]))
        elif m := re.match(r'\s*([\w.-]+)\s*=\s*"?([^"\n]*)', line):
            if section in ("package", "project") and m[1] == "name":
                name = m[2]
            elif section.endswith("dependencies"):
                out.append((name, "depends_on", m[1]))
    return out


EXTRACTORS = {**{e: code.extractor(e) for e in code.LANGUAGES}, "sql": ddl_edges, "md": markdown_edges, "json": manifest_edges, "toml": manifest_edges}


def extract(files: DataFrame) -> DataFrame:
    """(path, src, relation, dst) of files (path, text) by the extractor of their extension; Arrow-batched, one file at a time."""

    def run(batches):
        for batch in batches:
            rows = [(p, *e) for p, t in zip(batch["path"], batch["text"]) for e in EXTRACTORS.get((p or "").rsplit(".", 1)[-1].lower(), lambda _: [])(t)]
            yield pd.DataFrame(rows, columns=["path", "src", "relation", "dst"])

    return files.select("path", "text").mapInPandas(run, "path string, src string, relation string, dst string")


def memory_documents(files: DataFrame) -> DataFrame:
    """(path, outcome, at, nodes, question) of notes (path, text) with a front matter of `key: value` lines."""
    front = F.regexp_extract("text", r"(?s)\A---\n(.*?)\n---", 1)
    field = lambda k: F.nullif(F.trim(F.regexp_extract(front, rf"(?m)^{k}:\s*(.*)$", 1)), F.lit(""))
    nodes = F.filter(F.split(F.regexp_replace(F.coalesce(field("source_nodes"), F.lit("")), r"[\[\]\"']", ""), r",\s*"), lambda x: x != "")
    return files.select("path", field("outcome").alias("outcome"), F.try_to_timestamp(F.nullif(F.regexp_extract(F.coalesce(field("date"), F.lit("")), r"^\d{4}-\d\d-\d\d", 0), F.lit("")), F.lit("yyyy-MM-dd")).alias("at"), nodes.alias("nodes"), field("question").alias("question"))
