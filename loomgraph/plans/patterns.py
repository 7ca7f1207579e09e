"""Pattern queries: small Cypher, SPARQL and SQL/PGQ front ends that compile to one intermediate form and then to joins.

The form is a list of relations over named variables (node tables, edge tables, triples); relations that share a variable join on it, in an
order that always has a shared variable, so no cross product is ever planned. A disconnected pattern is an error.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.storage import materialize


class PatternError(ValueError):
    """A query outside the supported subset, or a pattern that would need a cross product."""


@dataclass
class GraphView:
    """Label -> node table (with its key column), type -> edge table (with its source and target columns).

    An edge is told from others of its type by the columns in `key`; without one by all its columns, so that edges equal in all count as one
    where a pattern must not use an edge twice.
    """

    nodes: dict[str, tuple[DataFrame, str]] = field(default_factory=dict)
    edges: dict[str, tuple[DataFrame, str, str]] = field(default_factory=dict)
    keys: dict[str, list[str]] = field(default_factory=dict)

    def node(self, label: str, df: DataFrame, key: str) -> "GraphView":
        self.nodes[label] = (df, key)
        return self

    def edge(self, kind: str, df: DataFrame, src: str, dst: str, key: list[str] | None = None) -> "GraphView":
        self.edges[kind] = (df, src, dst)
        self.keys[kind] = key or df.columns
        return self


@dataclass
class Relation:
    """A DataFrame whose columns are 'var.property' and, for the variable itself, 'var.'."""

    df: DataFrame
    variables: list[str]


def join_relations(relations: list[Relation]) -> DataFrame:
    """Join on shared variables, always taking a relation that shares one with what is joined so far."""
    left = list(relations)
    done, have = left[0].df, set(left[0].variables)
    left.pop(0)
    while left:
        at = next((i for i, r in enumerate(left) if have & set(r.variables)), None)
        if at is None:
            raise PatternError("the pattern is not connected; it would need a cross product")
        r = left.pop(at)
        shared = [v for v in r.variables if v in have]
        other = r.df
        for v in shared:
            other = other.withColumnRenamed(f"{v}.", f"__{v}")
        overlap = [c for c in other.columns if c in done.columns]
        other = other.drop(*overlap)
        cond = None
        for v in shared:
            one = F.col(f"`{v}.`") == F.col(f"`__{v}`")
            cond = one if cond is None else cond & one
        done = done.join(other, cond).drop(*[f"__{v}" for v in shared])
        have |= set(r.variables)
    return done


_NODE = re.compile(r"\(\s*(\w*)\s*(?::\s*(\w+))?\s*(\{[^}]*\})?\s*\)")
_REL = re.compile(r"(<)?-\[\s*(\w*)\s*:\s*(\w+)\s*(\*\s*(\d+)?\s*(\.\.)?\s*(\d+)?)?\s*(\{[^}]*\})?\s*\]-(>)?")
#: Hops that a pattern without an upper bound may take before it is refused.
MAX_HOPS = 64


def _sql_literal(value) -> str:
    """A parameter's value as a Spark SQL literal; strings are quoted, whatever they hold."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, float)):
        return repr(value) if value == value and abs(value) != float("inf") else f"double('{value}')"
    if isinstance(value, (list, tuple)):
        return f"({', '.join(map(_sql_literal, value))})"
    kind = {"datetime": "TIMESTAMP", "date": "DATE"}.get(type(value).__name__, "")
    return kind + "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _props(text: str | None) -> dict[str, str]:
    return dict(re.findall(r"(\w+)\s*:\s*('(?:[^']*)'|[\w.$-]+)", text or ""))


class CypherCompiler:
    """MATCH (patterns) [WHERE EXISTS {..}] [WHERE ..] RETURN [DISTINCT] .. [ORDER BY ..] [LIMIT n], UNION, WITH/LET/FILTER/NEXT chains.

    -[:R]-> and <-[:R]- have a direction, -[:R]- has none. *, *2, *2.., *..3 and *2..3 are trails. There is a row for each way to match, so
    parallel edges and several paths count each, and no relationship is bound twice within one MATCH.
    """

    def __init__(self, graph: GraphView, params: dict | None = None):
        self.graph, self.params, self.fresh = graph, params or {}, 0

    def _name(self) -> str:
        self.fresh += 1
        return f"_v{self.fresh}"

    def _literal(self, text: str):
        if text.startswith("$"):
            return self.params[text[1:]]
        if text.startswith("'"):
            return text[1:-1]
        return float(text) if "." in text else int(text) if re.fullmatch(r"-?\d+", text) else {"true": True, "false": False}[text]

    def _node_relation(self, var: str, label: str, props: dict) -> Relation:
        if label not in self.graph.nodes:
            raise PatternError(f"no node table for label {label}")
        df, key = self.graph.nodes[label]
        for k, v in props.items():
            df = df.where(F.col(k) == F.lit(self._literal(v)))
        return Relation(df.select(F.col(key).alias(f"{var}."), *[F.col(c).alias(f"{var}.{c}") for c in df.columns]), [var])

    def _edge_relation(self, var: str, kind: str, a: str, b: str, hops: tuple[int, int | None] | None, props: dict, both: bool, mark: str | None) -> Relation:
        """Edges from a to b (either way if both), or trails of hops[0] to hops[1] of them; mark: a column for the edges used."""
        if kind not in self.graph.edges:
            raise PatternError(f"no edge table for type {kind}")
        df, src, dst = self.graph.edges[kind]
        for k, v in props.items():
            df = df.where(F.col(k) == F.lit(self._literal(v)))
        key = F.struct(*[F.col(c) for c in self.graph.keys.get(kind, df.columns)])
        ends = lambda x, y: df.select(F.col(x).alias("from"), F.col(y).alias("to"), key.alias("edge"), F.struct("*").alias("row"))
        e = ends(src, dst)
        if both:
            e = e.union(ends(dst, src).where(F.col("from") != F.col("to")))
        if hops is None:
            marks = [F.array("edge").alias(mark)] if mark else []
            return Relation(e.select(F.col("from").alias(f"{a}."), F.col("to").alias(f"{b}."), *[F.col("row")[c].alias(f"{var}.{c}") for c in df.columns], *marks), [a, b])
        low, high = hops
        if low < 1 or high is not None and high < low:
            raise PatternError("a path has at least one hop and no more than its upper bound")
        e = e.select("from", "to", "edge")
        level = e.select("from", "to", F.array("edge").alias("used"))
        out = level if low == 1 else None
        for k in range(2, (high or MAX_HOPS) + 1):
            if high is None:
                level = materialize(level, "trails")
                if level.isEmpty():
                    break
            step = level.join(e.select(F.col("from").alias("to"), F.col("to").alias("next"), "edge"), "to")
            level = step.where(~F.array_contains("used", F.col("edge"))).select("from", F.col("next").alias("to"), F.array_append("used", F.col("edge")).alias("used"))
            if k >= low:
                out = level if out is None else out.union(level)
        else:
            if high is None and not level.isEmpty():
                raise PatternError(f"an unbounded path took more than {MAX_HOPS} hops")
        out = level.limit(0) if out is None else out
        return Relation(out.select(F.col("from").alias(f"{a}."), F.col("to").alias(f"{b}."), *([F.col("used").alias(mark)] if mark else [])), [a, b])

    def match(self, text: str) -> DataFrame:
        relations: list[Relation] = []
        edges: list[tuple] = []
        for part in _split_top(text):
            at, last = 0, None
            part = part.strip()
            pending = None
            while at < len(part):
                m = _NODE.match(part, at)
                if m:
                    var = m[1] or self._name()
                    if m[2]:
                        relations.append(self._node_relation(var, m[2], _props(m[3])))
                    elif m[3]:
                        raise PatternError("properties need a label")
                    if pending:
                        back, name, kind, hops, props, both = pending
                        a, b = (var, last) if back else (last, var)
                        edges.append((name, kind, a, b, hops, props, both))
                        relations.append(None)  # in its place among the nodes
                        pending = None
                    last = var
                else:
                    m = _REL.match(part, at)
                    if not m or last is None or m[1] and m[9]:
                        raise PatternError(f"can't read the pattern at: {part[at:at + 40]}")
                    hops = None
                    if m[4]:
                        hops = (int(m[5] or 1), int(m[7]) if m[7] else int(m[5]) if m[5] and not m[6] else None)
                    pending = (bool(m[1]), m[2] or self._name(), m[3], hops, _props(m[8]), not m[1] and not m[9])
                at = m.end()
                while at < len(part) and part[at].isspace():
                    at += 1
            if pending:
                raise PatternError("a relationship must end in a node")
        kinds = [e[1] for e in edges]
        marks = [f"#{i}" if kinds.count(kind) > 1 else None for i, kind in enumerate(kinds)]
        made = iter([self._edge_relation(*e, mark) for e, mark in zip(edges, marks)])
        df = join_relations([r or next(made) for r in relations])
        for i, mark in enumerate(marks):
            for other, kind in zip(marks[:i], kinds):
                if kind == kinds[i] and mark:
                    df = df.where(~F.arrays_overlap(F.col(f"`{other}`"), F.col(f"`{mark}`")))
        return df.drop(*[m for m in marks if m])

    def _expr(self, text: str, df: DataFrame) -> str:
        """Cypher expression to Spark SQL over columns named 'var.prop'."""
        text = re.sub(r"\$(\w+)", "\x00\\1\x00", text)  # values come in last, as literals
        text = re.sub(r"count\(\s*\*\s*\)", "count(1)", text, flags=re.I)
        text = re.sub(r"(\w+\.\w+)\s+STARTS WITH\s+('[^']*')", r"startswith(\1, \2)", text, flags=re.I)
        text = re.sub(r"(\w+\.\w+)\s+CONTAINS\s+('[^']*')", r"contains(\1, \2)", text, flags=re.I)
        text = re.sub(r"\bIN\s*\[([^\]]*)\]", r"IN (\1)", text, flags=re.I)
        parts = re.split(r"('[^']*')", text)
        for i in range(0, len(parts), 2):
            parts[i] = re.sub(r"\b([A-Za-z_]\w*)\.(\w+)\b", lambda m: f"`{m[1]}.{m[2]}`" if f"{m[1]}.{m[2]}" in df.columns else m[0], parts[i])
            parts[i] = re.sub(r"(?<![`.\w])([A-Za-z_]\w*)(?![\w`.(])", lambda m: f"`{m[1]}.`" if f"{m[1]}." in df.columns else m[0], parts[i])
        return re.sub(r"\x00(\w+)\x00", lambda m: _sql_literal(self.params[m[1]]), "".join(parts))

    def _return(self, df: DataFrame, text: str) -> DataFrame:
        distinct = bool(re.match(r"\s*DISTINCT\b", text, re.I))
        text = re.sub(r"^\s*DISTINCT\b", "", text, flags=re.I)
        items = []
        for item in _split_top(text):
            m = re.match(r"(.+?)\s+AS\s+(\w+)\s*$", item.strip(), re.I | re.S)
            body, alias = (m[1], m[2]) if m else (item.strip(), re.sub(r"\W+", "_", item.strip()))
            items.append((body.strip(), alias))
        aggregate = re.compile(r"^(count|sum|min|max|avg)\s*\(", re.I)
        keys = [(b, a) for b, a in items if not aggregate.match(b)]
        if len(keys) < len(items):
            grouped = df.groupBy(*[F.expr(self._expr(b, df)).alias(a) for b, a in keys])
            out = grouped.agg(*[F.expr(self._expr(b, df)).alias(a) for b, a in items if aggregate.match(b)]).select(*[a for _, a in items])
        else:
            out = df.select(*[F.expr(self._expr(b, df)).alias(a) for b, a in items])
        return out.distinct() if distinct else out

    def run(self, query: str) -> DataFrame:
        parts = re.split(r"\bUNION\s+ALL\b|\bUNION\b", query, flags=re.I)
        if len(parts) > 1:
            out = self.run(parts[0])
            for p in parts[1:]:
                out = out.union(self.run(p))
            return out if re.search(r"\bUNION\s+ALL\b", query, re.I) else out.distinct()
        clauses = _clauses(query.strip())
        df = None
        i = 0
        while i < len(clauses):
            word, body = clauses[i].upper(), clauses[i + 1] if i + 1 < len(clauses) else ""
            i += 2
            if word == "MATCH":
                df = self.match(body)
            elif word in ("WHERE", "FILTER"):
                df = self._where(df, body)
            elif word == "LET":
                name, expr = re.match(r"\s*(\w+)\s*=\s*(.+)", body, re.S).groups()
                df = df.withColumn(name, F.expr(self._expr(expr, df)))
            elif word in ("RETURN", "WITH"):
                df = self._return(df, body)
            elif word == "NEXT":
                i -= 1
            elif word == "ORDER BY":
                keys = [re.match(r"\s*(.+?)\s*(DESC|ASC)?\s*$", k, re.I).groups() for k in _split_top(body)]
                df = df.orderBy(*[F.expr(self._expr(k, df)).desc() if (d or "").upper() == "DESC" else F.expr(self._expr(k, df)) for k, d in keys])
            elif word == "LIMIT":
                df = df.limit(int(body))
            else:
                raise PatternError(f"unsupported clause {word}")
        return df

    def _where(self, df: DataFrame, body: str) -> DataFrame:
        m = re.search(r"(NOT\s+)?EXISTS\s*\{\s*(?:MATCH\s+)?((?:[^{}]|\{[^{}]*\})*)\}", body, re.I)
        if m:
            inner = self.match(m[2])
            shared = [c for c in inner.columns if c.endswith(".") and c in df.columns]
            df = df.join(inner.select(*[f"`{c}`" for c in shared]).distinct(), shared, "left_anti" if m[1] else "left_semi") if len(shared) else df
            body = re.sub(r"^\s*AND\b|\bAND\s*$", "", (body[: m.start()] + body[m.end() :]).strip(), flags=re.I).strip()
            if not body:
                return df
        return df.where(F.expr(self._expr(body, df)))


_CLAUSE = re.compile(r"\b(MATCH|WHERE|RETURN|ORDER BY|LIMIT|WITH|FILTER|LET|NEXT)\b", re.I)


def _clauses(text: str) -> list[str]:
    """Keyword, body, keyword, body .. at keywords outside brackets and quotes ('STARTS WITH' is an operator, not a clause)."""
    out, depth, quoted, last, at = [], 0, False, 0, 0
    while at < len(text):
        c = text[at]
        quoted ^= c == "'"
        depth += ((c in "([{") - (c in ")]}")) if not quoted else 0
        m = _CLAUSE.match(text, at) if depth == 0 and not quoted and (at == 0 or not (text[at - 1].isalnum() or text[at - 1] == "_")) else None
        if m and not re.search(r"STARTS\s+$", text[:at], re.I):
            out += [text[last:at], m[1]]
            last = at = m.end()
            continue
        at += 1
    return [x for x in [*out, text[last:]] if x.strip()]


def _split_top(text: str) -> list[str]:
    """Split at commas outside brackets and quotes."""
    out, depth, now, quoted = [], 0, "", False
    for c in text:
        quoted ^= c == "'"
        depth += (c in "([{") - (c in ")]}") if not quoted else 0
        if c == "," and depth == 0 and not quoted:
            out.append(now)
            now = ""
        else:
            now += c
    return [*out, now] if now.strip() else out


def cypher(graph: GraphView, query: str, params: dict | None = None) -> DataFrame:
    return CypherCompiler(graph, params).run(query)


def graph_table(graph: GraphView, query: str) -> DataFrame:
    """SQL/PGQ: SELECT .. FROM GRAPH_TABLE (name MATCH pattern [WHERE cond] COLUMNS (expr AS name, ..)) [WHERE ..] [ORDER BY ..]; the inner
    part goes through the Cypher form, the outer through Spark SQL."""
    m = re.search(r"GRAPH_TABLE\s*\(\s*\w+\s+MATCH\s+(.*?)\s+COLUMNS\s*\((.*?)\)\s*\)", query, re.I | re.S)
    if not m:
        raise PatternError("no GRAPH_TABLE")
    inner = CypherCompiler(graph).run(f"MATCH {re.sub(r' IS ', ':', m[1])} RETURN {m[2]}")
    return inner.sparkSession.sql(query[: m.start()] + " {gt} " + query[m.end() :], gt=inner)


RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"  # fixed value


def sparql(triples: DataFrame, query: str) -> DataFrame:
    """SELECT [DISTINCT] ?a ?b WHERE { patterns; `a`; ';' and ',' lists; path p+; FILTER(..) } [ORDER BY ..] over triples (s, p, o)."""
    prefixes = dict(re.findall(r"PREFIX\s+(\w*):\s*<([^>]*)>", query, re.I))
    m = re.search(r"SELECT\s+(DISTINCT\s+)?(.*?)\s*WHERE\s*\{(.*)\}\s*(?:ORDER BY\s+(.*))?$", query.strip(), re.I | re.S)
    if not m:
        raise PatternError("not a SELECT query")
    body = m[3]
    filters = re.findall(r"FILTER\s*\(((?:[^()]|\([^()]*\))*)\)", body, re.I)
    body = re.sub(r"FILTER\s*\((?:[^()]|\([^()]*\))*\)", "", body, flags=re.I)

    def term(text: str) -> str:
        text = text.strip()
        if text.startswith("<"):
            return text[1:-1]
        if text.startswith('"'):
            return re.match(r'"([^"]*)"', text)[1]
        return text

    def full(text: str) -> list[str]:
        """What a term matches: a prefixed name its full IRI (and itself, for stores that keep prefixed names), `a` rdf:type."""
        if text == "a":
            return ["a", RDF_TYPE]
        name, colon, rest = text.partition(":")
        return [term(text)] + ([prefixes[name] + rest] if colon and not text.startswith(("<", '"')) and name in prefixes else [])

    relations = []
    for statement in re.split(r"\.(?=\s|$)", body):
        subject = None
        for group in statement.split(";"):
            words = re.findall(r'\?\w+|<[^>]*>|"[^"]*"(?:\^\^\S+)?|[^\s,]+\+?|,', group.strip())
            if not words:
                continue
            if subject is None:
                subject, words = words[0], words[1:]
            pred, objects = words[0], [w for w in words[1:] if w != ","]
            for obj in objects:
                relations.append(_triple_relation(triples, subject, pred, obj, full))
    df = join_relations(relations)
    for f in filters:
        expr = re.sub(r"\?(\w+)", r"`\1.`", f).replace("&&", " AND ").replace("||", " OR ")
        expr = re.sub(r'"([^"]*)"(?:\^\^[\w:]+)?', r"'\1'", expr)
        expr = re.sub(r"(`\w+\.`)(\s*(?:[<>]=?|!?=)\s*-?\d)", r"try_cast(\1 AS DOUBLE)\2", expr)
        df = df.where(F.expr(expr))
    names = re.findall(r"\?(\w+)", m[2])
    out = df.select(*[F.col(f"`{n}.`").alias(n) for n in names])
    out = out.distinct() if m[1] else out
    if m[4]:
        keys = re.findall(r"(DESC|ASC)?\s*\(?\?(\w+)\)?", m[4], re.I)
        out = out.orderBy(*[F.desc(n) if d.upper() == "DESC" else F.asc(n) for d, n in keys])
    return out


def _triple_relation(triples: DataFrame, s: str, p: str, o: str, full) -> Relation:
    from loomgraph.operators.traverse import closure

    df = triples
    if p.endswith("+"):
        df = df.where(F.col("p").isin(full(p[:-1])))
        df = closure(df.select(F.col("s").alias("a"), F.col("o").alias("b"))).select(F.col("a").alias("s"), F.lit(p).alias("p"), F.col("b").alias("o"))
    elif not p.startswith("?"):
        df = df.where(F.col("p").isin(full(p)))
    cols, names = [], []
    for text, c in ((s, "s"), (p, "p"), (o, "o")):
        if text.startswith("?"):
            if text[1:] in names:
                df = df.where(F.col(c) == F.col(["s", "p", "o"][names.index(text[1:])]))
            else:
                cols.append(F.col(c).alias(f"{text[1:]}."))
                names.append(text[1:])
        elif c != "p":
            df = df.where(F.col(c).isin(full(text)))
    return Relation(df.select(*cols), names)


def plan_operators(df: DataFrame) -> list[str]:
    """Names of the physical operators Spark plans for df, outermost first."""
    text = df._jdf.queryExecution().sparkPlan().toString()
    return re.findall(r"^[\s:+|*()0-9-]*([A-Z]\w+)", text, re.M)


def lint_plan(df: DataFrame) -> list[str]:
    """Operators that don't scale: cross products and nested loops."""
    return [n for n in plan_operators(df) if n in ("CartesianProduct", "BroadcastNestedLoopJoin")]


# -- writes: new DataFrames, nothing in place -------------------------------------------------------------------------
def create_rows(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows, allowMissingColumns=True)


def set_property(table: DataFrame, where, column: str, value) -> DataFrame:
    return table.withColumn(column, F.when(where, F.lit(value)).otherwise(F.col(column)))


def delete_nodes(nodes: DataFrame, key: str, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without those in gone (key), and edges (src, dst) without those that touch them."""
    left = nodes.join(gone.select(key), key, "left_anti")
    e = edges.join(gone.select(F.col(key).alias("src")), "src", "left_anti").join(gone.select(F.col(key).alias("dst")), "dst", "left_anti")
    return left, e.select(*edges.columns)
