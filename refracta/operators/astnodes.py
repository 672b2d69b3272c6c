"""Python syntax trees.

One Arrow-batched function walks a text and returns its nodes as parallel arrays. Everything
computed from the nodes is a built-in array expression on the same row, so nothing is shuffled
or joined back. Many pairs of texts are compared without their nodes leaving Python: a tree is
then a sketch, its labels and branches with their counts.
"""

from __future__ import annotations

import ast
import warnings
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refracta.constants import FUNCTION_CHARS
from refracta.functions.distance import shares
from refracta.functions.metrics import keyword_complexity
from refracta.functions.text import let
from refracta.session import spread

_TEXTS, _NUMBERS = T.ArrayType(T.StringType()), T.ArrayType(T.IntegerType())
# One entry per node, breadth first; ``def_name`` has one per plain function instead.
# ``parent`` is the position of the parent node. ``block`` is the position of the function
# whose complexity a node counts towards, -1 inside nested functions, which are no part of
# the outer one and no block of their own, and NULL outside of functions; a class inside of a
# function or of a class is such a nested part too. ``class_at`` is the position of the
# outermost class around a node, itself included. ``branch`` numbers the node's label with
# those of its first child and next sibling, and how often they stood before; equal numbers
# of two trees are equal branches. ``kind`` numbers the label alone in the same way.
# ``def_lineno`` and ``def_end_lineno`` go with ``def_name``.
TREE_TYPE = T.StructType(
    [T.StructField("label", _TEXTS)]
    + [T.StructField(n, _NUMBERS) for n in ("parent", "block", "decisions", "lineno", "end_lineno")]
    + [T.StructField("def_name", _TEXTS), T.StructField("class_at", _NUMBERS), *[T.StructField(n, T.ArrayType(T.LongType())) for n in ("branch", "kind")]]
    + [T.StructField(n, _NUMBERS) for n in ("def_lineno", "def_end_lineno")]
    + [T.StructField(n, T.BooleanType()) for n in ("parse_ok", "compile_ok")]
)
NODE_FIELDS = TREE_TYPE.names[:6]
# What each use of a tree reads; the rest needs neither be computed nor sent.
COMPLEXITY_FIELDS = ("label", "block", "decisions", "class_at", "parse_ok")
DISTANCE_FIELDS = ("branch", "kind", "parse_ok")
FUNCTION_FIELDS = ("def_name", "def_lineno", "def_end_lineno")
# Trees are sent on after so many nodes, some 20 MB of Python objects.
_CHUNK_NODES = 1 << 16
_REJECTED = (SyntaxError, ValueError, RecursionError, MemoryError)
# Old types that no tree holds; the module lists them only once somebody has asked for one.
_OLD_TYPES = {"Num", "Str", "Bytes", "NameConstant", "Ellipsis"}
# Number of every node type, from 1, the same in all workers; 0 stands for no node.
_TYPES = {
    t: i
    for i, t in enumerate(
        sorted(n for n, v in vars(ast).items() if isinstance(v, type) and issubclass(v, ast.AST) and n not in _OLD_TYPES), 1
    )
}
_NUMBERS_OF = {getattr(ast, t): i for t, i in _TYPES.items()}
# Types without child nodes, and the fields of the others that may hold nodes.
_LEAVES = {t: n for t, n in _NUMBERS_OF.items() if not t._fields or t is ast.Constant}
_CHILD_FIELDS = {
    t: [f for f in t._fields if "ast." in repr(getattr(t, "_field_types", {}).get(f, "ast."))] for t in _NUMBERS_OF
}
# A sketch is an array of counts and what they count: numbered labels, which stay below
# 2 ** 10, and branches, which do not, each with its count from this bit on.
_COUNT_BIT = 30


def _catch_all(case: ast.match_case) -> bool:
    return isinstance(case.pattern, ast.MatchAs) and case.pattern.pattern is None


# Branch points one node adds, by node type; every other type adds none.
_DECISIONS = {
    ast.If: lambda n: 1,
    ast.IfExp: lambda n: 1,
    ast.Assert: lambda n: 1,
    ast.BoolOp: lambda n: len(n.values) - 1,
    ast.For: lambda n: 1 + bool(n.orelse),
    ast.AsyncFor: lambda n: 1 + bool(n.orelse),
    ast.While: lambda n: 1 + bool(n.orelse),
    ast.comprehension: lambda n: 1 + len(n.ifs),
    ast.Try: lambda n: len(n.handlers) + bool(n.orelse),
    ast.TryStar: lambda n: len(n.handlers) + bool(n.orelse),
    ast.Match: lambda n: sum(not _catch_all(case) for case in n.cases),
}

# Nodes that count towards complexity or open a block.
_MARKED = {*_DECISIONS, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef}


def _compiles(code: str) -> bool:
    try:
        compile(code, "<string>", "exec")
    except _REJECTED:
        return False
    return True


def _numbered(values: list[int], width: int) -> list[int]:
    """The values with the number of equal ones before them in the bits above ``width``."""
    seen: dict[int, int] = {}
    numbers = []
    for value in values:
        before = seen.get(value, 0)
        numbers.append((before << width) | value)
        seen[value] = before + 1
    return numbers


def _branches(kinds: list[int], parents: list[int | None]) -> list[int]:
    """Numbers of the nodes' branches; siblings stand side by side in breadth-first order."""
    first = [0] * len(kinds)
    following = [0] * len(kinds)
    for at in range(len(kinds) - 1, 0, -1):
        parent = parents[at]
        following[at] = first[parent]
        first[parent] = kinds[at]
    return _numbered([(k << 20) | (f << 10) | n for k, f, n in zip(kinds, first, following, strict=True)], 30)


def _walk(code: str | None, fields: Sequence[str] = TREE_TYPE.names) -> dict:
    """The tree of one text: the fields of ``TREE_TYPE``, the costly ones only when wanted."""
    tree_of = {n: [] for n in TREE_TYPE.names[:-2]} | {"parse_ok": None, "compile_ok": None}
    labels, parents, blocks, decisions, starts, ends, names, classes = (tree_of[n] for n in TREE_TYPE.names[:8])
    if code is None:
        return tree_of
    try:
        tree = ast.parse(code)
    except _REJECTED:
        return tree_of | {"parse_ok": False, "compile_ok": False}
    queue = [(tree, None, None, None)]
    for position, (node, parent, block, owner) in enumerate(queue):
        kind = type(node)
        if kind is ast.ClassDef:
            if block is not None or owner is not None:
                block = -1
            owner = position if owner is None else owner
        if kind is ast.FunctionDef or kind is ast.AsyncFunctionDef:
            block = position if block is None else -1
            if kind is ast.FunctionDef:
                names.append(node.name)
                tree_of["def_lineno"].append(node.lineno)
                tree_of["def_end_lineno"].append(node.end_lineno)
        labels.append(kind.__name__)
        parents.append(parent)
        blocks.append(block)
        classes.append(owner)
        count = _DECISIONS.get(kind)
        decisions.append(count(node) if count else 0)
        starts.append(getattr(node, "lineno", None))
        ends.append(getattr(node, "end_lineno", None))
        # The children as ``ast.iter_child_nodes`` gives them.
        for name in kind._fields:
            child = getattr(node, name, None)
            if isinstance(child, ast.AST):
                queue.append((child, position, block, owner))
            elif isinstance(child, list):
                queue.extend((c, position, block, owner) for c in child if isinstance(c, ast.AST))
    tree_of["parse_ok"] = True
    if "branch" in fields or "kind" in fields:
        kinds = [_TYPES[x] for x in labels]
        tree_of["branch"], tree_of["kind"] = _branches(kinds, parents), _numbered(kinds, 10)
    if "compile_ok" in fields:
        tree_of["compile_ok"] = _compiles(code)
    return tree_of


def _chunks(codes: pd.Series, fields: Sequence[str]) -> Iterator[pd.DataFrame]:
    """The trees of a batch in parts of bounded size, however large the trees are."""
    rows, nodes = [], 0
    for code in codes:
        tree = _walk(code, fields)
        rows.append([tree[f] for f in fields])
        nodes += len(tree["label"])
        if nodes >= _CHUNK_NODES:
            yield pd.DataFrame(rows, columns=list(fields), dtype=object)
            rows, nodes = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=list(fields), dtype=object)


def _sketch(code: str) -> tuple[Counter[int], int] | None:
    """Counted labels and branches of a text's tree, and its complexity; None without a tree.

    The same numbers as ``branch`` and ``kind`` of ``_walk`` hold and ``tree_complexity`` finds.
    """
    try:
        tree = ast.parse(code)
    except _REJECTED:
        return None
    branches = []
    add, numbers, leaves, fields_of, marked = branches.append, _NUMBERS_OF, _LEAVES, _CHILD_FIELDS, _MARKED
    # Blocks by their place in ``totals``: 0 for code outside of blocks and 1 for nested ones, which
    # do not count. ``methods`` has the blocks of the functions in each class.
    totals, methods = [0, 0], {}
    queue = [(tree, 0, 0)]
    push = queue.append
    for node, following, block in queue:
        kind = type(node)
        if kind in marked:
            if kind in _DECISIONS:
                totals[block] += _DECISIONS[kind](node)
            elif block and (block not in methods or kind is ast.ClassDef):
                block = 1
            else:
                if block:
                    methods[block].append(len(totals))
                block = len(totals)
                totals.append(1)
                if kind is ast.ClassDef:
                    methods[block] = []
        children = []
        for name in fields_of[kind]:
            child = getattr(node, name, None)
            if type(child) is list:
                children += child
            elif child is not None:
                children.append(child)
        after = 0
        for child in reversed(children):
            kind_of = type(child)
            if kind_of in leaves:
                number = leaves[kind_of]
                add(number << 20 | after)
            elif kind_of is ast.Name:  # the most frequent type, with a single leaf below
                number, context = numbers[kind_of], numbers[type(child.ctx)]
                add(number << 20 | context << 10 | after)
                add(context << 20)
            elif kind_of in numbers:
                number = numbers[kind_of]
                push((child, after, block))
            else:  # names and gaps in lists
                continue
            after = number
        add(numbers[kind] << 20 | after << 10 | following)
    counts = Counter(branches)
    labels: dict[int, int] = {}
    for branch, n in counts.items():
        label = branch >> 20
        labels[label] = labels.get(label, 0) + n
    dict.update(counts, labels)
    complexity = 1 if len(totals) == 2 else max(
        total if not methods.get(at) else _shared(total + sum(totals[m] for m in methods[at]), len(methods[at]))
        for at, total in enumerate(totals[2:], 2)
    )
    return counts, complexity


def _shared(total: int, methods: int) -> int:
    """Complexity of a class with methods from its total."""
    return total // methods + (methods > 1)


def _edit_bound(before: Sequence[int], after: Counter[int]) -> float:
    """``tree_distance_bound`` of two sketches."""
    mask = (1 << _COUNT_BIT) - 1
    size, shared, labels = 0, 0, 0
    for entry in before:
        value, n = entry & mask, entry >> _COUNT_BIT
        common = min(n, after.get(value, 0))
        if value < 1 << 10:
            size += n
            labels += common
        else:
            shared += common
    other = after.total() // 2
    edits = max(size, other) - labels
    return max(edits, -(-(size + other - 2 * shared) // 5)) / max(size, other)


@F.pandas_udf(T.ArrayType(T.LongType()))
def tree_sketch(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A text's tree for ``pair_parts``, as counted labels and branches; NULL without a tree."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for codes in batches:
            rows, entries = [], 0
            for code in codes:
                found = None if code is None else _sketch(code)
                rows.append(found and np.array([n << _COUNT_BIT | v for v, n in found[0].items()], np.int64))
                entries += 0 if found is None else len(found[0])
                if entries >= _CHUNK_NODES:
                    yield pd.Series(rows, dtype=object)
                    rows, entries = [], 0
            if rows:
                yield pd.Series(rows, dtype=object)


_PAIR_TYPE = T.StructType([T.StructField("bound", T.DoubleType()), T.StructField("complexity", T.IntegerType()), T.StructField("share", T.DoubleType())])


@F.pandas_udf(_PAIR_TYPE)
def pair_parts(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    """What scores read of a function and its result, from the function's ``tree_sketch``, its text
    without whitespace, the result's text and whether that is Python.

    ``bound`` is ``tree_distance_bound`` and ``complexity`` is ``tree_complexity`` of the result, NULL
    where the trees are missing. ``share`` is ``edit_shares`` of the texts without whitespace, where
    there is no bound. The result's tree is dropped as soon as it is compared.
    """
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for batch in batches:
            sketches, owns, results, parsed = (column.tolist() for column in batch)
            n = len(results)
            bounds, complexities = np.full(n, np.nan), np.full(n, np.nan)
            texts = []
            for i, (sketch, result, python) in enumerate(zip(sketches, results, parsed, strict=True)):
                found = _sketch(result) if python and result is not None else None
                if found is not None:
                    complexities[i] = found[1]
                    if sketch is not None:
                        bounds[i] = _edit_bound(sketch.tolist(), found[0])
                        continue
                if result is not None:
                    texts.append(i)
            shared = np.full(n, np.nan)
            # ``str.split`` parts a text at the characters that ``without_whitespace`` removes.
            shared[texts] = shares([owns[i] for i in texts], ["".join(results[i].split()) for i in texts])
            yield pd.DataFrame({"bound": bounds, "complexity": pd.array(complexities, "Int32"), "share": shared})


@cache
def _trees(fields: tuple[str, ...]):
    @F.pandas_udf(T.StructType([TREE_TYPE[f] for f in fields]))
    def trees(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            for codes in batches:
                yield from _chunks(codes, fields)

    return trees


def syntax_tree(text: Column, fields: Sequence[str] = TREE_TYPE.names) -> Column:
    """The given fields of a text's tree; NULL texts are not parsed and get no flags."""
    return _trees(tuple(fields))(text)


def with_tree(
    df: DataFrame, code: str = "code", out: str = "tree", only: Column | None = None,
    fields: Sequence[str] = TREE_TYPE.names,
) -> DataFrame:
    """Add the syntax tree of ``code``; rows outside ``only`` are not parsed and get no flags."""
    text = F.col(code) if only is None else F.when(only, F.col(code))
    return spread(df).withColumn(out, syntax_tree(text, fields))


def ast_nodes(df: DataFrame, tree: str = "tree") -> DataFrame:
    """One row per node next to the row's other columns."""
    t = F.col(tree)
    rest = [c for c in df.columns if c != tree]
    zipped = F.arrays_zip(*[t[f].alias(f) for f in NODE_FIELDS])
    labelled = F.transform(
        zipped, lambda n: n.withField("parent_label", F.get(t["label"], n["parent"]))
    )
    return df.select(*rest, F.posexplode(labelled).alias("node", "n")).select(
        *rest, "node", *[F.col("n")[f].alias(f) for f in (*NODE_FIELDS, "parent_label")]
    )


def tree_complexity(tree: Column) -> Column:
    """Complexity of the most complex block; 1 without blocks, NULL without a tree.

    Blocks are functions, methods and classes outside of other functions and classes. A
    function has 1 + its decision points. The total of a class is 1 + the decision points of
    its body + its methods' complexities; it counts with its total when it has no methods,
    else with the total per method, rounded down, and one more if there are several.
    """
    # Only branching nodes, functions and classes matter; few are left of a whole tree.
    nodes = F.transform(
        F.arrays_zip(*[tree[f].alias(f) for f in ("label", "block", "decisions", "class_at")]),
        lambda n, at: F.struct(
            n["block"].alias("block"),
            n["decisions"].alias("decisions"),
            n["class_at"].alias("class_at"),
            F.coalesce(n["block"] == at, F.lit(False)).alias("heads"),
            ((n["label"] == "ClassDef") & n["block"].isNull() & (n["class_at"] == at)).alias("opens"),
        ),
    )
    kept = F.filter(
        nodes,
        lambda n: (F.coalesce(n["block"], F.lit(0)) >= 0) & ((n["decisions"] > 0) | n["heads"] | n["opens"]),
    )

    def total(entries: Column, value) -> Column:
        return F.aggregate(entries, F.lit(0), lambda s, n: s + value(n))

    def most_complex(found: Column) -> Column:
        functions = F.transform(
            F.array_distinct(F.transform(F.filter(found, lambda n: n["block"].isNotNull()), lambda n: n["block"])),
            lambda b: 1 + total(F.filter(found, lambda n: n["block"] == b), lambda n: n["decisions"]),
        )

        def of_class(inside: Column) -> Column:
            methods = total(inside, lambda n: n["heads"].cast("int"))
            whole = 1 + total(inside, lambda n: n["decisions"] + n["heads"].cast("int"))
            shared = F.floor(whole / F.greatest(methods, F.lit(1))).cast("int") + (methods > 1).cast("int")
            return F.when(methods == 0, whole).otherwise(shared)

        classes = F.transform(
            F.filter(found, lambda n: n["opens"]),
            lambda c: of_class(F.filter(found, lambda n: n["class_at"] == c["class_at"])),
        )
        return F.coalesce(F.array_max(F.concat(functions, classes)), F.lit(1))

    return F.when(tree["parse_ok"], let(kept, most_complex))


def with_complexity(df: DataFrame, code: str = "code", out: str = "cyclomatic_complexity") -> DataFrame:
    """Tree-based complexity for Python, keyword-based otherwise or when there is no tree."""
    return (
        with_tree(df, code, "__tree", F.col("language") == "python", COMPLEXITY_FIELDS)
        .withColumn(out, F.coalesce(tree_complexity(F.col("__tree")), keyword_complexity(F.col(code))))
        .drop("__tree")
    )


def python_function_array(code: Column, tree: Column) -> Column:
    """Array of (name, code) for every plain ``def``, nested ones included, as whole lines."""
    named = F.arrays_zip(*[tree[f].alias(f) for f in FUNCTION_FIELDS])

    def cut(lines: Column) -> Column:
        def text(d: Column) -> Column:
            first, last = d["def_lineno"], d["def_end_lineno"]
            return F.array_join(F.slice(lines, first, last - first + 1), "\n")

        return F.transform(named, lambda d: F.struct(d["def_name"].alias("name"), text(d).alias("code")))

    return F.filter(
        let(F.split(code, "\n"), cut), lambda f: F.length(f["code"]).between(*FUNCTION_CHARS)
    )


def branch_distance(before: Column, after: Column) -> Column:
    """Binary branches of two trees that the other one lacks, repeats counted."""
    a, b = before["branch"], after["branch"]
    return F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))


def tree_distance_bound(before: Column, after: Column) -> Column:
    """Lower bound of the normalised edit distance between two syntax trees, in 0..1.

    One edit changes the multiset of node labels by at most one label on either side,
    so the larger one-sided multiset difference never exceeds the number of edits. It changes
    at most five binary branches (a node with its first child and next sibling), so neither
    does a fifth of the branches that one tree has and the other lacks. The larger of the two
    counts. NULL when either text has no tree.
    """
    a, b = before["kind"], after["kind"]
    edits = F.greatest(F.size(F.array_except(a, b)), F.size(F.array_except(b, a)))
    return F.when(
        before["parse_ok"] & after["parse_ok"],
        F.greatest(edits, F.ceil(branch_distance(before, after) / 5)) / F.greatest(F.size(a), F.size(b)).cast("double"),
    )
