"""Spelling variants: words one edit apart, and the common form of each.

Built-in functions only. The words make a trie whose unary chains are one edge
each, kept as a table of edges. States (word, rest of the word, node, edits)
walk it level by level: a level joins the states with the edges of their
nodes. A state without an edit follows every edge that its word matches, or
misses by one edit; a state with its edit spent follows exact matches only.
States that end a word with one edit spent are neighbours.

Nearness is symmetric, so a walk only replaces a code point by a larger one
and only skips code points of its own word; the other half of the pairs is the
reverse. An edge also knows the next two code points below it, so that states
without a next step are not made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.skew import HotKeys
from .common import stage

# How many times as frequent as a word its form is at least.
RATIO = 5
# Words through a node that are one part of a level's join at most, about.
NODE_WORDS = 10_000
# Rows of states or words that one task takes, about: small rows, each with many steps to try.
TASK_ROWS = 10_000
# Code points that an edge tells of what lies below it.
AHEAD = 2


def _prefix(length: str) -> str:
    return f"xxhash64(substring(word, 1, {length}))"


def _tasks(rows: int) -> int:
    return max(1, -(-rows // TASK_ROWS))


def _edges(words: DataFrame) -> DataFrame:
    """``level, node, parts, label, child, child_parts, ends, open, ahead``: an
    edge from node to child, in how many parts each is joined, the word that
    ends at the child, whether the child has edges, and what comes below it.

    Nodes are hashes of prefixes. A clash adds edges to a node, which makes
    further candidates but hides none.
    """
    spots = words.select("word", F.explode(F.expr("sequence(0, length(word))")).alias("at"))
    spots = spots.withColumns({"node": F.expr(_prefix("at")), "below": F.expr(f"substring(word, at + 1, {AHEAD})")})
    # Counted by what lies below first, so a node near the root is a few thousand rows.
    below = spots.groupBy("node", "below").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("least_at"))
    first = F.substring("below", 1, 1)
    nodes = below.groupBy("node").agg(
        F.sum("n").alias("n"), F.min(first).alias("low"), F.max(first).alias("high"), F.min("least_at").alias("least_at"),
        F.array_join(F.collect_list("below"), " ").alias("ahead"),
    )
    # Nodes: the root, where words part, and where they end.
    nodes = nodes.where("least_at = 0 or low <> high or low = ''")
    parts = F.ceil(F.col("n") / NODE_WORDS).cast("int")
    nodes = stage(nodes.select("node", parts.alias("parts"), (F.col("high") != "").alias("open"), "ahead"), "trie-nodes")

    marked, named = spots.select("word", "at", "node"), nodes.drop("ahead")
    hot = HotKeys.of(nodes.where("parts > 1").select("node", F.col("parts").alias("_parts")), ["node"])
    if hot is None:
        marked = marked.join(named, "node")
    else:
        marked = hot.added_to(marked).withColumn("_part", F.pmod(F.xxhash64("word"), F.coalesce("_parts", F.lit(1)))).drop("_parts")
        copies = F.explode(F.expr("transform(sequence(0, parts - 1), x -> bigint(x))"))
        marked = marked.join(named.withColumn("_part", copies), ["node", "_part"])
    steps = marked.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("at", "node", "parts", "open"))).alias("path"))
    pair = F.posexplode(F.expr("transform(sequence(1, size(path) - 1), i -> struct(path[i - 1] as a, path[i] as b))")).alias("level", "p")
    steps = steps.where("size(path) > 1").select("word", pair)
    found = steps.groupBy(
        "level", F.col("p.a.node").alias("node"), F.col("p.a.parts").alias("parts"),
        F.expr("substring(word, p.a.at + 1, p.b.at - p.a.at)").alias("label"),
        F.col("p.b.node").alias("child"), F.col("p.b.parts").alias("child_parts"), F.col("p.b.open").alias("open"),
    ).agg(F.max(F.expr("if(p.b.at = length(word), word, null)")).alias("ends"))
    tips = nodes.select(F.col("node").alias("child"), "ahead")
    return stage(found.join(tips, "child").withColumn("size", F.length("label")), "trie-edges")


def _rest(extra: int) -> str:
    return f"substring(rest, size + {extra + 1})"


def _goes_on(extra: int) -> str:
    """Whether a state with its edit spent has a next step, or has ended a word."""
    return f"if({_rest(extra)} = '', ends is not null, instr(ahead, substring(rest, size + {extra + 1}, {AHEAD})) > 0)"


def _replaced() -> str:
    met = "substring(rest, 1, size)"
    return f"(edits = 0 and label > {met} and length({met}) = size and {_goes_on(0)} and (size = 1 or levenshtein({met}, label, 1) = 1))"


def _skipped() -> str:
    met = "substring(rest, 1, size + 1)"
    return f"(edits = 0 and (size > 1 or instr({met}, label) > 0) and length({met}) = size + 1 and {_goes_on(1)} and levenshtein({met}, label, 1) = 1)"


def _matched() -> str:
    return f"(startswith(rest, label) and if(edits = 0, open and {_rest(0)} <> '', {_goes_on(0)}))"


def _moved(met: DataFrame) -> DataFrame:
    """What states become over the edges of their nodes: one code point further
    in the label for each of the word, or one more of the word."""
    # Most pairs of a state and an edge lead nowhere; those go before any row is made of them.
    met = met.where(f"{_matched()} or {_replaced()} or {_skipped()}")
    moves = [(_matched(), 0, "edits"), (_replaced(), 0, "1"), (_skipped(), 1, "1")]
    made = ", ".join(f"if({ok}, struct({_rest(extra)} as rest, {edits} as edits), null)" for ok, extra, edits in moves)
    after = met.select("word", F.explode(F.expr(f"array({made})")).alias("m"), "child", "child_parts", "ends").where("m is not null")
    return after.select("word", "m.rest", F.col("child").alias("node"), F.col("child_parts").alias("parts"), "m.edits", "ends")


def near_words(words: DataFrame) -> DataFrame:
    """``(word, near)`` for all pairs of distinct values of ``word`` that differ
    by one inserted, deleted or replaced code point, in both directions.

    Nulls are left out; the empty word is near every word of one code point.
    """
    words = stage(words.select("word").where("word is not null").distinct(), "words")
    n_states = words.count()
    words = words.repartition(_tasks(n_states), "word")
    edges = _edges(words)
    parts = max(1, -(-n_states // NODE_WORDS))
    states = words.select("word", F.col("word").alias("rest"), F.expr(_prefix("0")).alias("node"), F.lit(parts).alias("parts"), F.lit(0).alias("edits"))
    # No edge leads to the empty word: it is met by what follows the only code point of a word.
    short = words.where("length(word) = 1").withColumn("near", F.expr("substring(word, 2)"))
    pairs, level = [short.join(words.where("word = ''").select(F.col("word").alias("near")), "near").select("word", "near")], 0
    part = F.pmod(F.xxhash64("word"), F.col("parts")).alias("part")
    while True:
        here = edges.where(F.col("level") == level).withColumn("part", F.explode(F.expr("transform(sequence(0, parts - 1), x -> bigint(x))")))
        # The bytes of small rows would ask for fewer tasks than their steps do.
        tasks = _tasks(n_states)
        asked = states.select("word", "rest", "node", "edits", part).repartition(tasks, "node", "part")
        met = asked.join(here.drop("level", "parts").repartition(tasks, "node", "part"), ["node", "part"])
        after = _moved(met)
        after = stage(after, f"frontier-{level}")
        pairs.append(after.where("rest = ''").select("word", F.col("ends").alias("near")))
        states = after.where("rest <> ''").drop("ends")
        n_states = states.count()
        if not n_states:
            break
        level += 1
    found = pairs[0]
    for more in pairs[1:]:
        found = found.union(more)
    # Clashing hashes of prefixes may have led astray.
    found = found.where(F.levenshtein("word", "near", 1) == 1).distinct()
    return found.union(found.select(F.col("near").alias("word"), F.col("word").alias("near")))


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for rows ``(word, form)``, by doubling the steps until none is left.

    A form is more frequent than its word, so a chain ends and is short.
    """
    reached = forms.select("word", F.col("form").alias("root"))
    while True:
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        reached = stage(reached.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        moved = not reached.where("moved").isEmpty()
        reached = reached.drop("moved")
        if not moved:
            return reached


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for distinct words with counts ``n``.

    ``form`` is the near word of largest ``n`` (of equal ones the smallest in
    code-point order) if that is at least ``ratio`` times the word's own, else
    null; ``root`` follows forms to the last. Rows with a null word are left
    out, rows of one word are added up, a null count is 0. An empty table
    gives an empty one; other columns are not read.
    """
    counts = words.where("word is not null").groupBy("word").agg(F.sum(F.coalesce("n", F.lit(0))).cast("long").alias("n"))
    counts = stage(counts, "word-counts")
    pairs = near_words(counts).join(counts.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near"))
    near = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    told = counts.join(near, "word", "left")
    form_n = -F.col("best.minus")
    is_form = form_n >= ratio * F.col("n")
    told = told.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, form_n).cast("long").alias("form_n"),
    )
    told = stage(told, "forms")
    roots = _roots(told.where("form is not null and form <> word"))
    out = told.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
