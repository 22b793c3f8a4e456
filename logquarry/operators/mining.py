"""Template mining: a prefix tree trained on a bounded head of each file, matched everywhere.

Training is sequential by nature but reads at most `sample` lines of a file; it runs as one
task per file.  Its result, templates and tree nodes, is a pair of small tables; matching is
joins and column expressions.  A tree of bounded size is broadcast and walked level by level
with the lines where they are, so no line is shuffled and a file with a third of all rows
stays spread.  A larger tree is joined by file and masked prefix; the distinct prefixes that
are no path of it walk the tree in tasks keyed by file and salt.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import HEAD_LENGTH, MASKED, SPACE, WILDCARD, content_tokens, header, mask, tokens

DEPTH, BRANCHES, SIMILARITY, SAMPLE = 8, 100, 0.6, 1000
SEP = "\x01"
SALTS = 32
_MASKED = re.compile(MASKED.replace("$", r"\Z"))
_SPACE = re.compile(r"[\s\x1c-\x1f\x85]+")
MODEL = "file string, kind string, tid int, tokens array<struct<value:string,is_var:boolean>>, path string"


def masked(token: str) -> str:
    return WILDCARD if _MASKED.match(token) else token


@dataclass
class Node:
    next: dict[str, Node] = field(default_factory=dict)
    tid: int | None = None


class Miner:
    """Learns templates from token lists.  A template is a list of tokens, None for a variable."""

    def __init__(self, depth: int = DEPTH, branches: int = BRANCHES, similarity: float = SIMILARITY):
        self.depth, self.branches, self.similarity = depth, branches, similarity
        self.root = Node()
        self.templates: list[list[str | None]] = []

    def walk(self, keys: list[str]) -> int | None:
        """Greedy: the exact branch first, else the wildcard's; no way back."""
        node = self.root
        for k in keys:
            node = node.next.get(k) or node.next.get(WILDCARD)
            if node is None:
                return None
        return node.tid

    def alike(self, tid: int, toks: list[str]) -> bool:
        known = self.templates[tid - 1]
        return len(known) == len(toks) and sum(t is None or t == x for t, x in zip(known, toks, strict=True)) / len(toks) >= self.similarity

    def match(self, toks: list[str]) -> int | None:
        tid = self.walk([masked(t) for t in toks[: self.depth]]) if toks else None
        return tid if tid is not None and self.alike(tid, toks) else None

    def learn(self, toks: list[str]) -> int:
        """The template of the tokens, widened to cover them, or a new one; 0 without tokens."""
        if not toks:
            return 0
        tid = self.match(toks)
        if tid is None:
            self.templates.append(list(toks))
            self._hang([masked(t) for t in toks[: self.depth]], len(self.templates))
            return len(self.templates)
        self.templates[tid - 1] = [t if t == x else None for t, x in zip(self.templates[tid - 1], toks, strict=True)]
        return tid

    def _hang(self, keys: list[str], tid: int) -> None:
        """A full node takes no new branch: the wildcard's serves, or the template stays unreachable.
        A leaf keeps its first template."""
        node = self.root
        for k in keys:
            if k not in node.next:
                if len(node.next) >= self.branches:
                    if WILDCARD not in node.next:
                        return
                    k = WILDCARD
                else:
                    node.next[k] = Node()
            node = node.next[k]
        if node.tid is None:
            node.tid = tid

    def paths(self):
        """(path, template or None) of every node of the tree but the root."""
        stack = [((), self.root)]
        while stack:
            path, node = stack.pop()
            if path:
                yield SEP.join(path), node.tid
            stack += [((*path, k), n) for k, n in node.next.items()]


@dataclass
class Model:
    templates: DataFrame
    nodes: DataFrame
    depth: int = DEPTH
    similarity: float = SIMILARITY


def parsed(lines: DataFrame, head: int = HEAD_LENGTH) -> DataFrame:
    """lines with toks, header and content (the tokens after the header)."""
    with_tokens = lines.withColumn("toks", tokens(F.col("raw")))
    return with_tokens.withColumns({"header": header(F.col("toks"), head), "content": content_tokens(F.col("toks"), head)})


def train(lines: DataFrame, depth: int = DEPTH, branches: int = BRANCHES, similarity: float = SIMILARITY, sample: int = SAMPLE, head: int = HEAD_LENGTH) -> Model:
    """The model of each file, from its first `sample` lines in line order."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        miner = Miner(depth, branches, similarity)
        for toks in pdf.sort_values("line_no")["content"]:
            miner.learn(list(toks))
        file = pdf["file"].iloc[0]
        rows = [(file, "template", i, [{"value": WILDCARD if t is None else t, "is_var": t is None} for t in own], None) for i, own in enumerate(miner.templates, 1)]
        rows += [(file, "node", tid, None, path) for path, tid in miner.paths()]
        out = pd.DataFrame(rows, columns=["file", "kind", "tid", "tokens", "path"])
        return out.astype({"tid": "Int32"})

    first = parsed(lines.where(F.col("line_no") < sample), head).select("file", "line_no", "content")
    model = first.groupBy("file").applyInPandas(one, MODEL).persist()
    return Model(model.where("kind = 'template'").select("file", "tid", "tokens"), model.where("kind = 'node'").select("file", "path", "tid"), depth, similarity)


def _fallback(known: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
    miner = Miner()
    for path, tid in zip(known["path"], known["tid"], strict=True):
        node = miner.root
        for k in path.split(SEP):
            node = node.next.setdefault(k, Node())
        node.tid = None if pd.isna(tid) else int(tid)
    found = [miner.walk(p.split(SEP)) for p in wanted["prefix"]]
    return pd.DataFrame({"file": wanted["file"], "prefix": wanted["prefix"], "walked": pd.array(found, "Int32")})


def similarity(template: str, toks: str):
    """Share of positions that are equal or variable; 0 for different lengths."""
    equal = F.aggregate(F.zip_with(template, toks, lambda t, x: F.when(t["is_var"] | (t["value"] == x), 1).otherwise(0)), F.lit(0), lambda a, b: a + b)
    return F.when((F.size(template) == F.size(toks)) & (F.size(toks) > 0), equal / F.size(toks)).otherwise(F.lit(0.0))


def wildcards(template: str):
    """The positions of a template's variables, from 0."""
    places = F.transform(template, lambda t, i: F.when(t["is_var"], i).otherwise(-1))
    return F.filter(places, lambda i: i >= 0)


def variables(template: str, toks: str):
    both = F.zip_with(template, toks, lambda t, x: F.struct(t["is_var"].alias("v"), x.alias("x")))
    return F.transform(F.filter(both, lambda z: z["v"]), lambda z: z["x"])


def _walked(rows: DataFrame, model: Model) -> DataFrame:
    """rows with tid: the exact branch of each level, else the wildcard's, in broadcast joins alone."""
    now = rows.withColumns({"_path": F.when(F.size("keys") > 0, ""), "tid": F.lit(None).cast("int")})
    for level in range(model.depth):
        key = F.try_element_at("keys", F.lit(level + 1))
        step = lambda k, level=level: k if level == 0 else F.concat("_path", F.lit(SEP), k)
        now = now.withColumns({"_x": F.when(F.col("_path").isNotNull(), step(key)), "_w": F.when(F.col("_path").isNotNull() & key.isNotNull(), step(F.lit(WILDCARD)))})
        for column, tid, known in (("_x", "_tx", "_kx"), ("_w", "_tw", "_kw")):
            found = model.nodes.select("file", F.col("path").alias(column), F.col("tid").alias(tid), F.lit(True).alias(known))
            now = now.join(F.broadcast(found), ["file", column], "left")
        deeper = F.size("keys") > level
        path = F.when(F.col("_kx"), F.col("_x")).when(F.col("_kw"), F.col("_w"))
        tid = F.when(F.col("_kx"), F.col("_tx")).when(F.col("_kw"), F.col("_tw"))
        now = now.withColumns({"_path": F.when(deeper, path).otherwise(F.col("_path")), "tid": F.when(deeper, tid).otherwise(F.col("tid"))}).drop("_x", "_w", "_tx", "_tw", "_kx", "_kw")
    return now.drop("_path")


def _looked_up(rows: DataFrame, model: Model) -> DataFrame:
    """rows with tid, by joins on file and masked prefix; the prefixes that are no path walk the tree."""
    rows = rows.withColumn("prefix", F.array_join("keys", SEP))
    nodes = model.nodes.withColumnRenamed("tid", "exact").withColumn("known", F.lit(True))
    joined = rows.join(nodes.withColumnRenamed("path", "prefix"), ["file", "prefix"], "left")
    lost = rows.where(F.size("content") > 0).select("file", "prefix").distinct().join(nodes.select("file", F.col("path").alias("prefix")), ["file", "prefix"], "left_anti")
    salted = lost.withColumn("salt", F.pmod(F.hash("prefix"), F.lit(SALTS)))
    copies = model.nodes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    walked = copies.groupBy("file", "salt").cogroup(salted.groupBy("file", "salt")).applyInPandas(_fallback, "file string, prefix string, walked int").where("walked is not null")
    joined = joined.join(walked, ["file", "prefix"], "left")
    return joined.withColumn("tid", F.when(F.col("known"), F.col("exact")).otherwise(F.col("walked")))


def match(lines: DataFrame, model: Model, head: int = HEAD_LENGTH, small: int = 200_000) -> DataFrame:
    """lines with header, content, eid (-1: too few tokens, 0: no template), template and vars."""
    rows = parsed(lines, head).withColumn("keys", F.transform(F.slice("content", 1, model.depth), mask))
    few = model.nodes.count() <= small  # a table of the model, bounded by sample lines and depth per file
    hint = F.broadcast if few else (lambda d: d)
    joined = _walked(rows, model) if few else _looked_up(rows, model)
    joined = joined.join(hint(model.templates.withColumnRenamed("tokens", "template")), ["file", "tid"], "left")
    ok = (F.size("content") > 0) & F.col("template").isNotNull() & (similarity("template", "content") >= model.similarity)
    eid = F.when(F.size("toks") < head, -1).when(ok, F.col("tid")).otherwise(0)
    none = F.lit(None).cast("array<string>")
    return joined.select("file", "line_no", "raw", "header", "content", eid.alias("eid"), F.when(eid > 0, F.col("template")).alias("template"), F.when(eid > 0, variables("template", "content")).otherwise(none).alias("vars"))


def rebuilt(header: str = "header", template: str = "template", vars: str = "vars"):
    """The line of a header, a template and its variables: each variable takes the next value."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("i"))
    filled = F.aggregate(template, start, lambda s, t: F.struct(F.concat(s["out"], F.array(F.when(t["is_var"], F.coalesce(F.try_element_at(F.col(vars), s["i"] + 1), F.lit(""))).otherwise(t["value"]))).alias("out"), (s["i"] + t["is_var"].cast("int")).alias("i")), lambda s: s["out"])
    return F.concat_ws(" ", F.concat(F.col(header), filled))


def gated(matched: DataFrame) -> DataFrame:
    """Lines that their parts do not restore byte for byte count as not matched."""
    same = F.coalesce((F.col("eid") > 0) & (rebuilt() == F.col("raw")), F.lit(False))
    return matched.withColumn("exact", same)
