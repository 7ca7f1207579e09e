"""Readers for Turtle, N-Triples, JSON-LD in HTML, CSV; generators of regular and hashed graphs; tool table functions."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRIPLE = "s string, p string, o string, o_kind string, o_datatype string"

_TOKEN = re.compile(
    r"""(?P<space>\s+|\#[^\n]*)|(?P<iri><[^>]*>)|(?P<text>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|"(?:[^"\\\n]|\\.)*")(?:@(?P<lang>[\w-]+)|\^\^(?P<type><[^>]*>|[\w-]*:[\w.-]+))?|(?P<number>[+-]?\d+(?:\.\d+)?)"""
    r"""|(?P<inverse>\^(?=[\w<:]))|(?P<keyword>@prefix|@base|PREFIX)|(?P<bnode>_:\w+)|(?P<name>[\w-]*:[\w.-]*[\w-]|[\w-]*:|\ba\b|true|false)|(?P<punct>[.;,\[\]()])""",
    re.X,
)


def parse_turtle(text: str) -> list[tuple[str, str, str, str, str | None]]:
    """(s, p, o, o_kind, o_datatype) of a Turtle text: prefixes, ';' and ',' lists, typed literals, blank nodes in brackets, collections
    and inverse paths as blank nodes. Prefixed names stay as written."""
    tokens, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"Turtle: can't read {text[at:at + 30]!r}")
        at = m.end()
        if not m["space"]:
            tokens.append(m)
    out: list = []
    made = 0
    pos = 0

    def fresh() -> str:
        nonlocal made
        made += 1
        return f"_:t{made}"

    def peek() -> str:
        return tokens[pos][0] if pos < len(tokens) else ""

    def take():
        nonlocal pos
        pos += 1
        return tokens[pos - 1]

    def value() -> tuple[str, str, str | None]:
        m = take()
        if m["text"]:
            body = m["text"][3:-3] if m["text"].startswith('"""') else m["text"][1:-1]
            return re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t"}.get(x[1], x[1]), body), "literal", (m["type"] or "xsd:string").strip("<>")
        if m["number"]:
            return m[0], "literal", "xsd:decimal" if "." in m[0] else "xsd:integer"
        if m["iri"]:
            return m[0][1:-1], "iri", None
        if m["bnode"]:
            return m[0], "bnode", None
        if m[0] in ("true", "false"):
            return m[0], "literal", "xsd:boolean"
        if m[0] == "[":
            node = fresh()
            if peek() != "]":
                predicates(node, "]")
            take()
            return node, "bnode", None
        if m[0] == "(":
            items = []
            while peek() != ")":
                items.append(value())
            take()
            head = "rdf:nil"
            for item in reversed(items):
                node = fresh()
                out.append((node, "rdf:first", *item))
                out.append((node, "rdf:rest", head, "iri" if head == "rdf:nil" else "bnode", None))
                head = node
            return head, "iri" if head == "rdf:nil" else "bnode", None
        if m["inverse"]:
            node = fresh()
            out.append((node, "sh:inversePath", *value()))
            return node, "bnode", None
        return m[0], "iri", None

    def predicates(subject: str, end: str) -> None:
        while peek() not in (end, ""):
            p = value()[0]
            while True:
                o = value()
                out.append((subject, p, *o))
                if peek() != ",":
                    break
                take()
            while peek() == ";":
                take()

    while pos < len(tokens):
        if tokens[pos]["keyword"]:
            while take()[0] not in (".",) and pos < len(tokens) and not (tokens[pos - 1]["iri"] and peek() != "."):
                pass
            if peek() == ".":
                take()
            continue
        subject = value()[0]
        predicates(subject, ".")
        take()
    return out


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """Triples of Turtle files, one file a row through Spark's reader and parsed on executors (a file is the unit: its prefixes are global)."""
    files = spark.read.text(path, wholetext=True)

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = [r for text in b["value"] for r in parse_turtle(text)]
            yield pd.DataFrame(rows, columns=["s", "p", "o", "o_kind", "o_datatype"])

    return files.mapInPandas(run, TRIPLE)


def read_ntriples(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Line-based triples (s, p, o, o_kind, o_datatype, o_lang), split by Spark and parsed by one expression: the form for large inputs.

    Escapes in literals are resolved, language tags kept in o_lang. Blank lines and comments are passed over; any other line that is no triple
    fails the read, or with strict=False is left out.
    """
    line = F.col("value")
    pattern = r'^\s*(<[^>]*>|_:\w+)\s+<([^>]*)>\s+(<[^>]*>|_:\w+|"(?:[^"\\]|\\.)*")(?:\^\^<([^>]*)>|@([\w-]+))?\s*\.'
    part = lambda i: F.regexp_extract(line, pattern, i)
    o = part(3)
    kind = F.when(o.startswith("<"), "iri").when(o.startswith("_:"), "bnode").otherwise("literal")
    broken = F.raise_error(F.concat(F.lit("no triple: "), line)).cast("boolean") if strict else F.lit(False)
    rows = spark.read.text(path).where(F.when(line.rlike(pattern), True).when(line.rlike(r"^\s*(#.*)?$"), False).otherwise(broken))
    bare = F.regexp_replace(o, '^[<"]|[>"]$', "")
    quoted = F.concat(F.lit('{"x":"'), F.replace(bare, F.lit("\\'"), F.lit("'")), F.lit('"}'))  # the same escapes as JSON's, but for one
    text = F.when(o.contains("\\"), F.coalesce(F.from_json(quoted, "x string")["x"], bare)).otherwise(bare)
    return rows.select(F.regexp_replace(part(1), "[<>]", "").alias("s"), part(2).alias("p"), text.alias("o"), kind.alias("o_kind"), F.when(part(5) != "", "rdf:langString").when(kind == "literal", F.coalesce(F.nullif(part(4), F.lit("")), F.lit("xsd:string"))).alias("o_datatype"), F.nullif(part(5), F.lit("")).alias("o_lang"))


JSON_LD = r"""(?is)<script[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""


def extract_jsonld(html: Column) -> Column:
    """array of the JSON-LD bodies in a page."""
    return F.regexp_extract_all(html, F.lit(JSON_LD), F.lit(1))


def flatten_jsonld(body: str) -> list[tuple[str, str, str]]:
    """(s, p, o) of the JSON-LD objects in a body: @context is left out, @type is the predicate a, lists give a row for each item, nested
    objects become _:b1, _:b2 .. in the order they open; values outside of objects give no rows;
    an object's own name is its url, else its name, else _:root."""
    parsed = json.loads(body)
    roots = parsed if isinstance(parsed, list) else [parsed]
    rows: list[tuple[str, str, str]] = []
    opened = 0
    # A stack of (subject, remaining pairs) keeps document order without recursion, however deep the nesting.
    stack = [(r.get("url") or r.get("name") or "_:root", iter(_pairs(r))) for r in reversed(roots) if isinstance(r, dict)]
    while stack:
        subject, pairs = stack[-1]
        pair = next(pairs, None)
        if pair is None:
            stack.pop()
        elif isinstance(pair[1], dict):
            opened += 1
            rows.append((subject, pair[0], f"_:b{opened}"))
            stack.append((f"_:b{opened}", iter(_pairs(pair[1]))))
        else:
            rows.append((subject, pair[0], pair[1] if isinstance(pair[1], str) else json.dumps(pair[1])))
    return rows


def _pairs(obj: dict) -> list[tuple[str, object]]:
    """(predicate, one value) in order, without @context."""
    named = [("a" if k == "@type" else k, v) for k, v in obj.items() if k != "@context"]
    return [(k, one) for k, v in named for one in (v if isinstance(v, list) else [v])]


def jsonld_triples(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, s, p, o) of all JSON-LD in pages; bodies that are no JSON give no rows."""
    bodies = pages.select(id_col, F.explode(extract_jsonld(F.col(html_col))).alias("body"))
    kind = pages.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("s", T.StringType()), T.StructField("p", T.StringType()), T.StructField("o", T.StringType())])

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for i, body in zip(b[id_col], b["body"]):
                try:
                    rows += [(i, *t) for t in flatten_jsonld(body)]
                except ValueError:
                    continue
            yield pd.DataFrame(rows, columns=[id_col, "s", "p", "o"])

    return bodies.mapInPandas(run, schema)


def page_links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(src, href) of every link in a page."""
    return pages.select(F.col(id_col).alias("src"), F.explode(F.regexp_extract_all(html_col, F.lit(r'href="([^"]*)"'), F.lit(1))).alias("href"))


def read_csv(spark: SparkSession, path: str, schema: str, fail: bool = True) -> DataFrame:
    """Positional bulk load with declared types; a value of another type fails the load (or, with fail=False, becomes null)."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if fail else "PERMISSIVE").csv(path)


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def series(spark: SparkSession, n: int, modulo: int) -> DataFrame:
    return spark.range(n).select(F.col("id"), (F.col("id") % modulo).alias("grp"))


def grid_dag(spark: SparkSession, width: int, height: int) -> DataFrame:
    """(src, dst) right and down in a grid, cell number row * width + column."""
    cell = spark.range(width * height)
    right = cell.where(F.col("id") % width < width - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    down = cell.where(F.col("id") < width * (height - 1)).select(F.col("id").alias("src"), (F.col("id") + width).alias("dst"))
    return right.union(down)


def random_graph(spark: SparkSession, n: int, degree: int, seed: int = 1, skew: float = 1.0, groups: int = 1, bridges: float = 0.0, negative: float = 0.0) -> DataFrame:
    """(src, dst, w) from hashes of (seed, edge number): about n * degree / 2 edges. skew > 1 pulls one end to small numbers; with groups, ends
    stay in a group but for a share of bridges; a share of weights is negative. Same seed, same graph, on any partitioning."""
    e = spark.range(n * degree // 2)
    u = lambda k: (F.xxhash64(F.lit(seed), F.lit(k), "id").bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40)))
    size = max(1, n // groups)
    a = F.floor(u(1) * n)
    inside = F.floor(a / size) * size + F.floor(F.pow(u(2), F.lit(skew)) * size)
    b = F.when(u(3) < bridges, F.floor(u(4) * n)).otherwise(inside)
    w = (F.floor(u(5) * 9) + 1) * F.when(u(6) < negative, -1).otherwise(1)
    out = e.select(a.cast("long").alias("src"), F.least(b, F.lit(n - 1)).cast("long").alias("dst"), w.cast("long").alias("w"))
    return out.where("src <> dst").groupBy("src", "dst").agg(F.min("w").alias("w"))


def extractor(docs: DataFrame, answers: DataFrame) -> DataFrame:
    """A scripted extractor: the raw (doc_id, s, p, o, quote) rows recorded for each document."""
    return docs.select("doc_id").join(answers, "doc_id")


def register_tools(spark: SparkSession, people: DataFrame, max_depth: int = 16) -> None:
    """SQL table functions over people (id, name, team, boss): find_person(name), team_members(team), chain_of_command(id).

    chain_of_command gives (level, id, name) from the person (level 0) up to the top; it is a join a level, max_depth levels at most (also of a
    circle of bosses).
    """
    people.createOrReplaceTempView("tool_people")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION find_person(who STRING) RETURNS TABLE (id STRING, name STRING, team STRING) RETURN SELECT id, name, team FROM tool_people WHERE name = who")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION team_members(which STRING) RETURNS TABLE (id STRING, name STRING) RETURN SELECT id, name FROM tool_people WHERE team = which")
    ups = [f"SELECT {k} AS level, p{k}.id, p{k}.name FROM tool_people p0 {' '.join(f'JOIN tool_people p{i} ON p{i}.id = p{i - 1}.boss' for i in range(1, k + 1))} WHERE p0.id = whose" for k in range(max_depth)]
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION chain_of_command(whose STRING) RETURNS TABLE (level INT, id STRING, name STRING) RETURN {' UNION ALL '.join(ups)}")


def tools(spark: SparkSession) -> list[str]:
    return sorted(f.name for f in spark.catalog.listFunctions() if f.isTemporary)


#: The table functions of register_tools() with their one parameter.
TOOLS = {"chain_of_command": ("whose", "STRING"), "find_person": ("who", "STRING"), "team_members": ("which", "STRING")}


def tool_schemas(spark: SparkSession) -> DataFrame:
    """(tool, parameter, type) of the table functions that this session has, as a client discovers them before it calls one."""
    rows = [(name, *parameter) for name, parameter in TOOLS.items() if spark.catalog.functionExists(name)]
    return spark.createDataFrame(rows, "tool string, parameter string, type string")


def random_rows(spark: SparkSession, n: int, columns: dict[str, list | tuple], seed: int = 1) -> DataFrame:
    """n rows (id, columns): a list gives one of its values, a pair of numbers a whole number from the first to before the second.

    Values are drawn from a hash of seed, column and id: the same rows on any partitioning.
    """
    def draw(name: str, body):
        h = F.xxhash64(F.lit(seed), F.lit(name), "id")
        if isinstance(body, list):
            return F.element_at(F.array(*map(F.lit, body)), (F.pmod(h, F.lit(len(body))) + 1).cast("int"))
        low, high = body
        return F.pmod(h, F.lit(high - low)) + low

    return spark.range(n).select("id", *[draw(k, v).alias(k) for k, v in columns.items()])


def preferential_graph(spark: SparkSession, n: int, links: int, seed: int = 1) -> DataFrame:
    """(src, dst): node k >= 1 links `links` times to earlier nodes, each drawn as an end of an earlier link or, as often, as an earlier node.

    An end of a random earlier link is a node in proportion to its degree. Chains of such draws are followed by joins: a draw names a slot of
    an earlier node, whose own draw is looked up in turn; half of the draws end each round, and slots always lead to earlier nodes.
    """
    from loomgraph.storage import materialize

    h = lambda k: F.xxhash64(F.lit(seed), F.lit(k), "slot")
    slots = spark.range(links * (n - 1)).select(F.col("id").alias("slot"), (F.floor(F.col("id") / links) + 1).alias("src"))
    to = F.pmod(h(1), F.col("src"))  # an earlier node
    copied = F.pmod(h(2), F.greatest((F.col("src") - 1) * links, F.lit(1)))  # a slot of an earlier node
    s = materialize(slots.select("slot", "src", F.when((F.pmod(h(3), F.lit(2)) == 0) | (F.col("src") == 1), to).alias("dst"), copied.alias("at")), "slots")
    found, left = s.where("dst is not null").select("slot", "src", "dst"), s.where("dst is null").select("slot", "src", "at")
    ends = s.select(F.col("slot").alias("at"), F.col("dst").alias("end"), F.col("at").alias("next"))
    while not left.isEmpty():
        step = materialize(left.join(ends, "at"), "slots")
        found = found.union(step.where("end is not null").select("slot", "src", F.col("end").alias("dst")))
        left = step.where("end is null").select("slot", "src", F.col("next").alias("at"))
    return found.select("src", "dst")
