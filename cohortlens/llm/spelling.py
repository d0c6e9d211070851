"""Spelling variants: words one edit apart, found by walking (word, position, node, edits) states down a trie.

The trie of all words is a distributed edge table, a row per node that several words share with its edges (a node has at most
one edge per letter of the alphabet and one for the end).  A frontier of states joins it level by level.  A state without
edits branches: another letter instead of the word's next one, or one more letter before it.  A state with its edit spent
follows the one edge of its next letter until it ends at a word (a neighbour) or there is no such edge.  An edge below which
there is one word only carries that word, which ends the walk at once.

One of the two halves of a word is without the edit, so words are walked forwards with edits in their second half, and
spelled backwards, in a second trie, with edits in that half: no state branches near a root, where nodes have many words and
many edges.  A deletion is an insertion seen from the other word, and a replacement is made from the smaller letter to
the larger one, so each pair is found once or twice and stated in both directions.

Defined results: a null or empty text has no words; a text of any length is read whole, in runs of ``CHUNK`` words; a document without id hashes
with the empty id; repeated documents count again; empty tables give no rows; other columns are not read.  The walk takes as many rounds as
the longest way that an edited word shares with two other words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from cohortlens.llm.shared import text_slices, written

RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
CHUNK = 1 << 18
#: A task sends its counts on when it holds this many words.
HELD = 400_000
#: States of at most so many letters, and 16 a state, are sent to the edges; more of them meet in a shuffle.
SENT = 1 << 20


def word_counts(docs: DataFrame, least_points: int, typo_every: int | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): runs of letters a-z and U+00C0-U+00FF of ``least_points`` code points and more, added up in the tasks.

    With ``typo_every`` every occurrence whose crc32 with the document id is a multiple of it loses a letter.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for part, texts in text_slices(batches):
            for doc, body in zip(part.column(0).to_pylist(), texts):
                prefix = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                found = RUN.finditer(body.lower())
                while runs := [m.group() for m in islice(found, CHUNK)]:
                    held.update(runs)
                    if typo_every:
                        hashes = np.fromiter(map(zlib.crc32, runs, repeat(prefix)), np.uint32, len(runs))
                        for i in np.flatnonzero(hashes % typo_every == 0):
                            letters = runs[i].decode()
                            at = int(hashes[i]) % len(letters)
                            held[runs[i]] -= 1
                            held[(letters[:at] + letters[at + 1 :]).encode()] += 1
                if len(held) > HELD:
                    yield _counted(held, least_points)
                    held.clear()
        yield _counted(held, least_points)

    counted = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _counted(held: Counter, least_points: int) -> pa.RecordBatch:
    words = pa.array(list(held), pa.binary()).cast(pa.string())
    counts = pa.array(list(held.values()), pa.int64())
    rows = pa.RecordBatch.from_arrays([words, counts], ["word", "n"])
    return rows.filter(pc.and_(pc.greater_equal(pc.utf8_length(words), least_points), pc.greater(counts, 0)))


def _node(side: Column, way: Column) -> Column:
    """Identity of the node that a way of letters from the root leads to."""
    return F.xxhash64(side, way)


def _letter(spelled: Column, at: Column) -> Column:
    """The letter at a 0-based position, empty at the end of the word."""
    return F.substring(spelled, at + 1, F.lit(1))


def _met(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join by shuffle: Spark takes an exploded table for as small as its words, and a written one for its packed size,
    and would send either through the driver."""
    return left.join(right.hint("merge"), on, how)


def both_ways(words: DataFrame) -> DataFrame:
    """(id, side, spelled): every word forwards (side 0) and backwards (1)."""
    ids = words.select(F.xxhash64("word").alias("id"), F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("word").alias("spelled")), F.struct(F.lit(1).alias("side"), F.reverse("word").alias("spelled")))).alias("way"))
    return ids.select("id", "way.*")


def edge_table(words: DataFrame, top: int) -> DataFrame:
    """(node, edges): nodes from level ``top`` down that two and more words pass, edges of (letter, n, id).

    ``n`` words pass an edge; where it is one, ``id`` is that word's.
    """
    at = F.explode(F.sequence(F.lit(top), F.length("spelled"))).alias("at")
    steps = both_ways(words).where(F.length("spelled") >= top).select("id", "side", "spelled", at)
    steps = steps.select(_node(F.col("side"), F.substring("spelled", F.lit(1), F.col("at"))).alias("node"), _letter(F.col("spelled"), F.col("at")).alias("letter"), "id")
    edges = steps.groupBy("node", "letter").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    nodes = edges.groupBy("node").agg(F.sum("n").alias("passing"), F.collect_list(F.struct("letter", "n", "id")).alias("edges"))
    return nodes.where("passing > 1").select("node", "edges")


def neighbours(words: DataFrame, least_points: int) -> DataFrame:
    """(a, b) ids of words exactly one inserted, deleted or replaced code point apart, in both directions."""
    top = least_points // 2
    edges = written(edge_table(words, top), "trie")
    start = both_ways(words)
    at = F.explode(F.sequence(F.floor(F.length("spelled") / 2).cast("int"), F.length("spelled"))).alias("at")
    start = start.select("id", "side", "spelled", at).select(
        F.col("id").alias("origin"), "side", "spelled", "at", _node(F.col("side"), F.substring("spelled", F.lit(1), F.col("at"))).alias("node"))
    branch = _met(start, edges, "node").select("origin", "side", "spelled", "at", F.explode("edges").alias("edge")).select("origin", "side", "spelled", "at", "edge.*")
    own = _letter(F.col("spelled"), F.col("at"))
    kept, rest = F.substring("spelled", F.lit(1), F.col("at")), F.substring(F.col("spelled"), F.col("at") + 1, F.length("spelled"))
    edits = F.array(
        F.when(F.col("letter") > own, F.when(own != "", F.concat(kept, "letter", F.substring(F.col("spelled"), F.col("at") + 2, F.length("spelled"))))),
        F.concat(kept, "letter", rest),
    )
    branch = branch.where((F.col("letter") != "") & (F.col("letter") != own)).select("origin", "side", (F.col("at") + 1).alias("at"), F.explode(F.filter(edits, lambda x: x.isNotNull())).alias("way"), "n", "id")
    frontier = written(_ended(branch), "frontier")
    finds = [frontier]
    while (states := frontier.where("n > 1").agg(F.count(F.lit(1)), F.sum(F.length("way") + 16)).first())[0]:
        state = frontier.where("n > 1").select("origin", "side", "way", "at", _node(F.col("side"), F.substring("way", F.lit(1), F.col("at"))).alias("node"))
        joined = edges.join(F.broadcast(state), "node") if states[1] <= SENT else _met(state, edges, "node")
        step = joined.withColumn("edge", F.get(F.filter("edges", lambda e: e["letter"] == _letter(F.col("way"), F.col("at"))), F.lit(0)))
        step = step.where("edge IS NOT NULL").select("origin", "side", "way", (F.col("at") + 1).alias("at"), F.col("edge.n").alias("n"), F.col("edge.id").alias("id"))
        frontier = written(_ended(step), "frontier")
        finds.append(frontier)
    pairs = finds[0]
    for more in finds[1:]:
        pairs = pairs.unionByName(more)
    pairs = pairs.where("n = 1").select(F.col("origin").alias("a"), F.col("id").alias("b"))
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def _ended(states: DataFrame) -> DataFrame:
    """Drop states on edges of one word that is not the edited one."""
    spelled = F.when(F.col("side") == 0, F.col("way")).otherwise(F.reverse("way"))
    return states.where(F.when(F.col("n") > 1, F.col("at") <= F.length("way")).otherwise(F.col("id") == F.xxhash64(spelled)))


def spelling_variants(docs: DataFrame, least_points: int = 6, least_n: int = 5, times: int = 5, typo_every: int | None = 199, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root.

    A word's form is its most frequent neighbour (ties: the first in code-point order) if that is ``times`` as frequent; its
    root is the end of the chain of forms.  Frequencies grow by ``times`` at each form, so chains are short.
    """
    words = written(word_counts(docs, least_points, typo_every, key, text).where(F.col("n") >= least_n), "words")
    ids = words.withColumn("a", F.xxhash64("word"))
    near = _met(neighbours(words, least_points), ids.select(F.col("a").alias("b"), F.struct((-F.col("n")).alias("less"), "word").alias("other")), "b")
    best = near.groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min("other").alias("best"))
    joined = _met(ids, best, "a", "left")
    is_form = -F.col("best.less") >= times * F.col("n")
    formed = written(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")), "forms")
    step = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:  # each round doubles the part of the chain that is known
        onward = step.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = written(_met(step, onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        step = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            break
    return _met(formed, step, "word", "left").withColumn("root", F.coalesce("root", "word"))
