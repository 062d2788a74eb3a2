"""Syntax trees as rows: unit, node_id (preorder), parent_id, child_idx, depth, post_id, subtree_end, node_type, label.

A subtree is a range of node_ids, so containment is a range condition beside the equality on unit, never recursion."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NODE_SCHEMA = "unit string, node_id int, parent_id int, child_idx int, depth int, post_id int, subtree_end int, node_type int, label string"
SAMPLE = 2000
ARITHMETIC, COMPARISON, LOGICAL, BITWISE, ASSIGNMENT = 75, 76, 77, 78, 79
_TOKENS = {ARITHMETIC: "++ -- % / * - +", COMPARISON: "!== === >= <= > < != ==", LOGICAL: "not or and ! || &&", BITWISE: ">> << ~ ^ | &", ASSIGNMENT: "^= |= &= %= /= *= -= += ="}
_SIGNS = "".join(chr(0x100 + k) for k in range(1000))
_NAMED = "0 BLOCK 1 IF 2 FOR 3 WHILE 4 SWITCH 5 RETURN 7 CONTINUE 8 BREAK 9 TRY 10 THROW 11 ASSIGN 20 EQ 21 NE 22 GT 23 LT 26 ADD 27 SUB 28 MUL 29 DIV 41 INDEX 42 FIELD_ACCESS 43 CALL 44 METHOD_CALL 45 LAMBDA 50 VARIABLE 51 NUMBER 52 STRING 60 FUNCTION 61 CLASS 62 STRUCT 65 VAR_DECL 99 UNKNOWN".split()
TYPE_NAMES = dict(zip(map(int, _NAMED[::2]), _NAMED[1::2]))
OPERATOR_TOKENS = {kind: tuple(tokens.split()) for kind, tokens in _TOKENS.items()}


def rows(unit: str, tree: tuple) -> list[tuple]:
    """Rows of a tree of (type, [children]) or (type, label), of any depth."""
    out: list[list] = []
    post = 0
    open_: list[tuple[int, Iterator]] = []  # nodes whose children are being walked

    def enter(t: tuple, parent: int | None, at: int, depth: int) -> None:
        kids = t[1] if len(t) > 1 and isinstance(t[1], list) else []
        open_.append((len(out), iter(enumerate(kids))))
        out.append([unit, len(out), parent, at, depth, 0, 0, t[0], t[1] if len(t) > 1 and isinstance(t[1], str) else ""])

    enter(tree, None, 0, 0)
    while open_:
        me, kids = open_[-1]
        kid = next(kids, None)
        if kid is not None:
            enter(kid[1], me, kid[0], len(open_))
            continue
        open_.pop()
        out[me][5], out[me][6] = post, len(out) - 1
        post += 1
    return [tuple(r) for r in out]


def operator_type(token: Column) -> Column:
    expr = F.lit(None).cast("int")
    for kind, tokens in OPERATOR_TOKENS.items():
        expr = F.when(token.isin(*tokens), kind).otherwise(expr)
    return expr


def measures(nodes: DataFrame) -> DataFrame:
    """unit, size, depth (edges to the deepest leaf) and leaves."""
    return nodes.groupBy("unit").agg(F.count("*").alias("size"), (F.max("depth") - F.min("depth")).alias("depth"), F.count_if(F.col("node_id") == F.col("subtree_end")).alias("leaves"))


def leaves(nodes: DataFrame) -> DataFrame:
    return nodes.filter("node_id = subtree_end")


def histogram(nodes: DataFrame) -> DataFrame:
    """unit, term (node type) and n; types outside 0 to 99 don't count."""
    return nodes.filter(F.col("node_type").between(0, 99)).groupBy("unit", F.col("node_type").alias("term")).agg(F.count("*").alias("n"))


def type_name(node_type: Column) -> Column:
    """The name of a node type; "OTHER" for the types that have none of their own."""
    return F.coalesce(F.create_map([F.lit(x) for kv in TYPE_NAMES.items() for x in kv])[node_type], F.lit("OTHER"))


def unmapped(nodes: DataFrame) -> DataFrame:
    return nodes.filter("node_type = 99").groupBy("label").agg(F.count("*").alias("n"))


def flatten(nodes: DataFrame, node_type: int) -> DataFrame:
    """The tree without its non-root nodes of a type, whose children move up to the nearest node that stays.

    Two sorted passes over each unit: how many nodes that go contain a node is a running sum over where they begin and
    end, and a node's parent is the last node before it that is one level higher."""
    gone = (F.col("node_type") == node_type) & F.col("parent_id").isNotNull()
    marked = nodes.select("unit", "node_id", "subtree_end", "depth", "node_type", "label", gone.alias("gone"))
    none = F.lit(None)
    ends = lambda at, by: marked.filter("gone").select("unit", at.alias("node_id"), F.lit(by).alias("step"), none.cast("int").alias("depth"), none.cast("int").alias("node_type"), none.cast("string").alias("label"))
    steps = ends(F.col("node_id") + 1, 1).unionByName(ends(F.col("subtree_end") + 1, -1))
    kept = marked.filter(~F.col("gone")).select("unit", "node_id", F.lit(0).alias("step"), "depth", "node_type", "label").unionByName(steps)
    running = Window.partitionBy("unit").orderBy("node_id").rangeBetween(Window.unboundedPreceding, 0)
    level = kept.withColumn("fewer", F.sum("step").over(running)).filter("depth IS NOT NULL").select("unit", "node_id", (F.col("depth") - F.col("fewer")).cast("int").alias("depth"), "node_type", "label")
    offered = level.select("unit", F.col("depth").alias("level"), "node_id", F.col("node_id").alias("offer"), F.lit(False).alias("asks"), "depth", "node_type", "label")
    asking = level.select("unit", (F.col("depth") - 1).alias("level"), "node_id", none.cast("int").alias("offer"), F.lit(True).alias("asks"), "depth", "node_type", "label")
    before = Window.partitionBy("unit", "level").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    return offered.unionByName(asking).withColumn("parent_id", F.last("offer", True).over(before)).filter("asks").select("unit", "node_id", "parent_id", "depth", "node_type", "label")


def binary(nodes: DataFrame) -> DataFrame:
    """unit, node_id, left (first child) and right (next sibling)."""
    first = nodes.filter("parent_id IS NOT NULL").groupBy("unit", F.col("parent_id").alias("node_id")).agg(F.min_by("node_id", "child_idx").alias("left"))
    w = Window.partitionBy("unit", "parent_id").orderBy("child_idx")
    return nodes.select("unit", "node_id", F.when(F.col("parent_id").isNotNull(), F.lead("node_id").over(w)).alias("right")).join(first, ["unit", "node_id"], "left").select("unit", "node_id", "left", "right")


def dump(nodes: DataFrame) -> DataFrame:
    """unit and the indented outline of its tree."""
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.col("node_type").cast("string"))
    return nodes.groupBy("unit").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", line.alias("line")))), lambda x: x["line"]), "\n").alias("outline"))


def sequences(nodes: DataFrame, most: int = SAMPLE) -> DataFrame:
    """unit, size, stride and sequence: a character of its own for each node's type (0 to 999) in postorder, of every stride-th node where
    there are more than ``most``."""
    size = nodes.groupBy("unit").agg(F.count("*").alias("size")).withColumn("stride", F.when(F.col("size") > most, F.ceil(F.col("size") / most)).otherwise(1).cast("int"))
    code = F.substr(F.lit(_SIGNS), F.col("node_type") + 1, F.lit(1))
    picked = nodes.join(size, "unit").filter(F.col("post_id") % F.col("stride") == 0)
    return picked.groupBy("unit", "size", "stride").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("post_id", code.alias("c")))), lambda x: x["c"]), "").alias("sequence"))


def edit_distances(pairs: DataFrame, seq: DataFrame) -> DataFrame:
    """pairs (a, b) with distance (of samples, times the stride) and similarity (1 - distance / larger size, 0 at least)."""
    a = seq.select(F.col("unit").alias("a"), F.col("size").alias("na"), F.col("stride").alias("ka"), F.col("sequence").alias("sa"))
    b = seq.select(F.col("unit").alias("b"), F.col("size").alias("nb"), F.col("stride").alias("kb"), F.col("sequence").alias("sb"))
    d = pairs.join(a, "a").join(b, "b").withColumn("distance", F.levenshtein("sa", "sb") * F.greatest("ka", "kb"))
    return d.select(*pairs.columns, "distance", F.greatest(F.lit(0.0), 1.0 - F.col("distance") / F.greatest("na", "nb")).alias("similarity"))


def contained(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """root_id of each node within the subtrees of roots (unit, root_id, root_end), the roots themselves included."""
    return nodes.join(roots, "unit").filter("node_id BETWEEN root_id AND root_end")
