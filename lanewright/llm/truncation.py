"""Texts that stop before their author did.

Evidence, gathered over the whole corpus and over distinct texts:

* prefix: the text (without a mark of omission) is a strict prefix of a longer
  text elsewhere that goes on within the sentence.  All texts and all texts
  without their marks are sorted together; what a text is a prefix of follows
  it directly, so one sweep over range partitions finds every case without
  comparing pairs, and what a partition leaves open (a chain of prefixes of
  its last value) is looked up in a second pass over all texts.
* ending: how often the text's last words occur elsewhere at an end and in the
  middle of a sentence, by contexts of one to four words, and whether the last
  word is only the beginning of a word that follows there elsewhere.  Contexts
  are 64-bit hashes, counted a batch at a time in arrays, of texts without their
  marks of omission.  Counts are held against each other, so that verdicts do not
  drift as the corpus grows: where many texts are cut, some stop at any place.
* limit: the length (in characters or bytes) at which texts of a source that
  stop in mid-sentence pile up.
* report: the feed announced more characters than the text has bytes, or the
  text ends in a broken character.

A text is cut if a report or a prefix says so, if its ending is one that goes
on, or if it lies at its source's limit with an ending that is not known to
end texts elsewhere.  Texts that end with a full stop are whole unless a
report says otherwise, also when a longer copy exists (the copy was added to).

Defined results: null, empty and blank texts are never cut; documents without
source share no limit; copies of a text get the same evidence, their reports
are their own; an empty table gives no rows; texts are read whole.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanewright.runtime import stored

TOKEN = re.compile(r"<[^<>\n]{1,80}>|[\r\n]+|[^\W_]+(?:['’.:/-][^\W_]+)*|[^\w\s]|_")
STOPS = frozenset(".!?。！？…")
CLOSED = re.compile(r"(?:[.!?。！？][\"'”’)»\]]+|[”»])$")
#: Marks of omission that feeds append, as text.
MARKS = ("[...]", "[…]", "…read on", "read on", "(more)", "...", "…", "�")
MARK = re.compile(" ?(?:" + "|".join(map(re.escape, MARKS)) + ")$")
MARKED = 1 + max(map(len, MARKS))
#: Ends that always go on: marks within a sentence and tags that are not closed (but "<3").
OPEN = r"[,;:(–<]$|<[/!|]+$|<[/!|]*\p{L}[\p{L}\d|_-]*(\s[^<>\n=]*=[^<>\n]*)?$"
#: Words of context, least occurrences for a context to count, share of ends from which an ending is natural.
DEPTH, SUPPORT, NATURAL = 4, 5, 0.3
#: Times as often as a text stops at any place that texts without a mark must stop at one for the ending to be known.
EXCESS = 2
#: Times a whole word may occur for each longer word that begins with it, in the same place, for the longer ones to be meant.
WHOLE = 0.05
#: A text this much shorter than the limit (in characters or bytes) may have been cut at a word; marks may exceed it.
SLACK = 14
#: Cut texts of a source that must lie at a limit.
PILE = 5
#: Characters below which a longer copy counts only if the text's ending is not one that ends texts elsewhere.
SHORT = 16
#: Characters of open cores that are looked up in one pass.
BLOCK = 20_000_000
#: Tokens a worker remembers, and counts it holds before it adds equal ones up; neither changes a result.
REMEMBERED, HELD = 400_000, 3_000_000


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text)


#: Hashes of a number, a name, the start of a sentence, and the key under which all tokens are counted.
NUMBER, NAME, START, POSITIONS = (np.uint64(_hash(x)) for x in ("#", "N", "^", "positions"))
#: Kinds of tokens: words and marks, full stops, breaks (line ends and tags), and the end of a text.
WORD, STOP, BREAK, END = range(4)


def _mixed(a: np.ndarray, b: np.ndarray | np.uint64 | int) -> np.ndarray:
    """A hash of two hashes, element by element."""
    x = a * np.uint64(0x9E3779B97F4A7C15) ^ (np.asarray(b, np.uint64) + np.uint64(0x632BE59BD9B4E019))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Lexicon(dict):
    """Numbers of tokens; what is known of each is in arrays by that number.  Token 0 ends a text."""

    def __init__(self) -> None:
        super().__init__()
        self.kind, self.form, self.low, self.named, self.words = [END], [0], [0], [False], [""]

    def __missing__(self, token: str) -> int:
        first, low = token[0], token.lower()
        number = any(map(str.isdigit, token))
        kind = BREAK if first in "\r\n" or (first == "<" and len(token) > 2) else STOP if token in STOPS else WORD
        self.kind.append(kind)
        self.form.append(_hash("\n" if kind == BREAK else token if kind == STOP else "#" if number else low))
        self.low.append(_hash(low) if kind == WORD and not number else 0)
        self.named.append(kind == WORD and not number and first.isupper())
        self.words.append(low if kind == WORD and not number else "")
        self[token] = len(self.kind) - 1
        return len(self.kind) - 1


class Tokens:
    """Many texts as arrays, one place per token and one more (``END``) after each text."""

    def __init__(self, texts: list[str], lexicon: Lexicon) -> None:
        look = lexicon.__getitem__
        codes: list[int] = [0]
        for text in texts:
            codes.extend(map(look, TOKEN.findall(text)))
            codes.append(0)
        self.code = np.array(codes, np.int64)
        self.kind = np.array(lexicon.kind, np.int8)[self.code]
        self.low = np.array(lexicon.low, np.uint64)[self.code]
        bound = self.kind > WORD
        name = np.array(lexicon.named)[self.code]
        name[1:] &= ~bound[:-1]  # a capital at a start is no name
        self.form = np.where(name, NAME, np.array(lexicon.form, np.uint64)[self.code])
        self.bound = bound
        # names in a row count as one, the last
        kept = np.ones(len(codes), bool)
        kept[:-1] = ~(name[:-1] & name[1:])
        self.kept = np.flatnonzero(kept)

    def contexts(self, wanted: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of the ``wanted`` places (in ``kept``): for each number of tokens, which have such a context
        in their sentence or line, and its key; a sentence shorter than ``DEPTH`` has one more key for its start."""
        form, bound = self.form[self.kept], self.bound[self.kept]
        out = [(wanted, _mixed(form[wanted], 1))]
        at, key = wanted, form[wanted]
        for k in range(1, DEPTH):
            before = at - k
            start = bound[before]
            key = np.where(start, _mixed(key, START), _mixed(key, form[before]))
            out.append((at, _mixed(key, 1)))
            at, key = at[~start], key[~start]
        return out

    def leads(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the one and the two tokens before each place; a sentence starts with ``START``."""
        first = (self.kind[at - 1] == STOP) | (self.kind[at - 1] == END)
        p = np.where(first, START, self.form[at - 1])
        two = np.maximum(at - 2, 0)
        q = np.where(first, np.uint64(0), np.where((self.kind[two] == STOP) | (self.kind[two] == END), START, self.form[two]))
        return _mixed(p, 2), _mixed(_mixed(p, q), 3)


class Counts:
    """Sums of (final, ended, mid, marked) by key."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, column: int, n: np.ndarray | None = None) -> None:
        keys, place = np.unique(keys, return_inverse=True)
        rows = np.zeros((len(keys), 4), np.int64)
        rows[:, column] = np.bincount(place, weights=n, minlength=len(keys)).astype(np.int64)
        self.held.append((keys, rows))
        self.size += len(keys)

    def summed(self) -> pa.RecordBatch:
        keys, place = np.unique(np.concatenate([k for k, _ in self.held]), return_inverse=True)
        rows = np.concatenate([r for _, r in self.held])
        sums = [np.bincount(place, weights=rows[:, c], minlength=len(keys)).astype(np.int64) for c in range(4)]
        self.held, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *map(pa.array, sums)], ["key", "final", "ended", "mid", "marked"])


#: How often a context ends a text, is followed by a full stop, goes on; and ends a text before a mark of omission.
FINAL, ENDED, MID, OMITTED = range(4)


def _counted(tokens: Tokens, lexicon: Lexicon, counts: Counts) -> None:
    """Adds one batch: contexts by what follows them, words in context and their beginnings."""
    n = len(tokens.code)
    counts.add(np.array([POSITIONS]), MID, np.array([(tokens.kind != END).sum()]))
    at = np.flatnonzero(tokens.kind[tokens.kept] == WORD)
    follows = tokens.kind[np.minimum(tokens.kept + 1, n - 1)]
    column = np.where(follows == END, FINAL, np.where(follows == WORD, MID, ENDED))
    for own, key in tokens.contexts(at):
        for c in (FINAL, ENDED, MID):
            if len(some := key[column[own] == c]):
                counts.add(some, c)
    # words that are not the text's last, by the one and the two tokens before them
    words = np.flatnonzero((tokens.low != 0) & (np.append(tokens.kind[1:], END) != END))
    if not len(words):
        return
    one, two = tokens.leads(words)
    counts.add(two, MID)
    for lead in (one, two):
        order = np.lexsort((tokens.code[words], lead))
        lead, code = lead[order], tokens.code[words][order]
        new = np.ones(len(order), bool)
        new[1:] = (lead[1:] != lead[:-1]) | (code[1:] != code[:-1])
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(order)))
        lead, code = lead[first], code[first]
        counts.add(_mixed(lead, tokens.low[words][order][first]), ENDED, times)
        own, place = np.unique(code, return_inverse=True)
        beginnings = [[_hash(w[:j]) for j in range(1, len(w))] for w in map(lexicon.words.__getitem__, own.tolist())]
        sizes = np.array([len(b) for b in beginnings])
        flat = np.array([h for b in beginnings for h in b], np.uint64)
        if len(flat):
            m = sizes[place]
            base = np.repeat((np.cumsum(sizes) - sizes)[place], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            counts.add(_mixed(np.repeat(lead, m), flat[base]), MID, np.repeat(times, m))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, final, ended, mid, marked): occurrences of contexts, words in context and word beginnings;
    final counts the ends before a mark of omission, marked only those."""
    lexicon, counts = Lexicon(), Counts()
    for batch in batches:
        for lo in range(0, batch.num_rows, 2000):
            cores, marks = zip(*map(core_of, batch.column(0).slice(lo, 2000).to_pylist()))
            tokens = Tokens(list(cores), lexicon)
            _counted(tokens, lexicon, counts)
            last = (np.flatnonzero(tokens.code == 0)[1:] - 1)[[mark is not None for mark in marks]]
            for _, key in tokens.contexts(np.searchsorted(tokens.kept, last[tokens.kind[last] == WORD])):
                counts.add(key, OMITTED)
            if len(lexicon) > REMEMBERED:
                lexicon = Lexicon()
            if counts.size > HELD:
                yield counts.summed()
    if counts.held:
        yield counts.summed()


def core_of(text: str) -> tuple[str, str | None]:
    """The text without white space and mark of omission at its end, and the mark."""
    core = text.rstrip()
    found = MARK.search(core, max(0, len(core) - MARKED))
    mark = found.group().strip() if found else None
    if found:
        core = core[: found.start()].rstrip()
        while core.endswith("�"):
            core = core[:-1].rstrip()
    return core, mark


def _endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of texts that end without a full stop: the text without its mark, the mark, the keys of
    its last contexts (longest first) and the keys about its last word."""
    lexicon = Lexicon()
    for batch in batches:
        rows = [(i, *core_of(text)) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        # most texts end with a full stop and without a mark: they need no tokens
        rows = [r for r in rows if r[1] and (r[2] or not (r[1][-1] in STOPS or CLOSED.search(r[1])))]
        if not rows:
            continue
        tokens = Tokens([core for _, core, _ in rows], lexicon)
        end = np.flatnonzero(tokens.code == 0)[1:]
        last = end - 1
        empty = tokens.kind[last] == END
        stopped = (tokens.kind[last] == STOP) | (tokens.kind[last] == BREAK)
        keys: list[list[int]] = [[] for _ in rows]
        own = np.flatnonzero(~empty & ~stopped)
        place = np.searchsorted(tokens.kept, last[own])
        back = dict(zip(place.tolist(), own.tolist()))
        for at, key in tokens.contexts(place):
            for j, x in zip(at.tolist(), key.view(np.int64).tolist()):
                keys[back[j]].insert(0, x)
        one, two = tokens.leads(np.maximum(last, 1))
        word, named = tokens.low[last], tokens.form[last] == NAME
        about = [x.view(np.int64).tolist() for x in (_mixed(one, word), _mixed(two, word), two)]
        out = []
        for j, (i, core, mark) in enumerate(rows):
            if empty[j] or (not mark and (stopped[j] or CLOSED.search(core))):
                continue
            asks = bool(word[j]) and not stopped[j]
            out.append((i, core, mark, keys[j], [a[j] for a in about] if asks else [], bool(named[j])))
        if out:
            ids, cores, marks, ks, ab, names = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(cores, pa.string()), pa.array(marks, pa.string()), pa.array(ks, pa.list_(pa.int64())), pa.array(ab, pa.list_(pa.int64())), pa.array(names)], ["text_id", "core", "mark", "keys", "about", "named"])
        if len(lexicon) > REMEMBERED:
            lexicon = Lexicon()


def _goes_on(core: str, text: str) -> bool:
    """Whether ``text`` continues the sentence in which ``core`` stops."""
    rest = text[len(core) : len(core) + 2]
    return rest[:1].isalnum() or (rest[:1] in "  " and rest[1:].isalnum())


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over sorted values: cores that a later text goes on from (``hit``) and the
    cores that the partition leaves open (``open``)."""
    waiting: list[tuple[str, str]] = []

    def rows(kind: str, found: list[tuple[str | None, str | None]]) -> pa.RecordBatch:
        ids, values = zip(*found)
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(found)), pa.array(ids, pa.string()), pa.array(values, pa.string())], ["kind", "text_id", "value"])

    for batch in batches:
        hits: list[tuple[str | None, str | None]] = []
        for value, is_text, text_id in zip(*(c.to_pylist() for c in batch.columns)):
            while waiting and not value.startswith(waiting[-1][0]):
                waiting.pop()
            if is_text:
                done = [x for x in waiting if _goes_on(x[0], value)]
                if done:
                    hits += [(i, None) for _, i in done]
                    waiting = [x for x in waiting if not _goes_on(x[0], value)]
            else:
                waiting.append((value, text_id))
        if hits:
            yield rows("hit", hits)
    if waiting:
        yield rows("open", [(i, v) for v, i in waiting])


def _looked_up(cores: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over texts in any order: which of ``cores`` (sorted, distinct) a text goes on from."""
    # the longest other core that each core starts with
    up: list[int] = []
    chain: list[int] = []
    for i, core in enumerate(cores):
        while chain and not core.startswith(cores[chain[-1]]):
            chain.pop()
        up.append(chain[-1] if chain else -1)
        chain.append(i)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits: set[int] = set()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                i = bisect_right(cores, text) - 1
                while i >= 0:
                    if i not in hits and text.startswith(cores[i]) and _goes_on(cores[i], text):
                        hits.add(i)
                    i = up[i]
        yield pa.RecordBatch.from_arrays([pa.array([cores[i] for i in hits], pa.string())], ["value"])

    return look


def _blocks(values: DataFrame, chars: int) -> Iterator[list[str]]:
    """The one column of ``values``, sorted in blocks of about ``chars`` characters."""
    block, n = [], 0
    for (value,) in values.toLocalIterator():
        block.append(value)
        n += len(value)
        if n >= chars:
            yield sorted(block)
            block, n = [], 0
    if block:
        yield sorted(block)


def continued(texts: DataFrame, cores: DataFrame, block_chars: int = BLOCK) -> DataFrame:
    """(text_id): cores (text_id, core) that are strict prefixes of a longer text
    (text_id, text) which goes on within the sentence."""
    values = texts.select(F.col("text").alias("value"), F.lit(True).alias("is_text"), "text_id").unionByName(cores.select(F.col("core").alias("value"), F.lit(False).alias("is_text"), "text_id"))
    swept = stored(values.repartitionByRange("value", "is_text").sortWithinPartitions("value", "is_text").mapInArrow(_sweep, "kind string, text_id string, value string"), "swept")
    hits = swept.where(F.col("kind") == "hit").select("text_id")
    left = swept.where(F.col("kind") == "open").select("text_id", "value")
    # one chain of prefixes per partition; its longer texts may lie in any number of later ones
    for block in _blocks(left.select("value").distinct(), block_chars):
        found = stored(texts.select("text").mapInArrow(_looked_up(block), "value string"), "found").distinct()
        hits = hits.unionByName(left.join(found, "value", "left_semi").select("text_id"))
    return hits.distinct()


def judged_endings(texts: DataFrame) -> DataFrame:
    """(text_id, mark, state, known, natural, continued) of distinct texts (text_id, text)
    that end without a full stop; state is mid, partial, end or unknown, known whether
    texts stop there more often than anywhere."""
    counts = texts.select("text").mapInArrow(_count, "key long, final long, ended long, mid long, marked long").groupBy("key").agg(*(F.sum(c).alias(c) for c in ("final", "ended", "mid", "marked")))
    counts = stored(counts, "contexts")
    ends = stored(texts.select("text_id", "text").mapInArrow(_endings, "text_id string, core string, mark string, keys array<long>, about array<long>, named boolean"), "endings")
    positions = (counts.where(F.col("key") == int(POSITIONS.view(np.int64))).agg(F.sum("mid")).first()[0] or 0) + 1
    rate = ends.count() / positions

    roles = F.flatten(F.array(F.transform("keys", lambda k, i: F.struct(F.concat(F.lit("g"), (F.size("keys") - i).cast("string")).alias("role"), k.alias("key"))), F.transform("about", lambda k, i: F.struct(F.concat(F.lit("a"), i.cast("string")).alias("role"), k.alias("key")))))
    asked = ends.select("text_id", "named", F.col("mark").isNull().alias("unmarked"), F.explode(roles).alias("r")).select("text_id", "named", "unmarked", "r.role", "r.key")
    # a key has one row of counts, so a frequent key is split by the skew join where it must be, and not before
    own = F.when(F.col("role").startswith("g"), 1).otherwise(0)
    bare = F.coalesce(F.col("final") - F.col("marked"), F.lit(0)) - F.when(F.col("unmarked"), own).otherwise(0)
    got = asked.join(counts, "key", "left").select("text_id", "named", "role", bare.alias("bare"), (F.coalesce("final", F.lit(0)) - own).alias("final"), F.coalesce("ended", F.lit(0)).alias("ended"), F.coalesce("mid", F.lit(0)).alias("mid"))
    picked = [F.max(F.when(F.col("role") == f"{kind}{i}", F.struct("final", "ended", "mid", "bare"))).alias(f"{kind}{i}") for kind, n in (("g", range(1, DEPTH + 1)), ("a", range(3))) for i in n]
    wide = got.groupBy("text_id", "named").agg(*picked)
    # the longest context that is frequent enough
    best = F.coalesce(*(F.when(F.col(f"g{i}.final") + F.col(f"g{i}.ended") + F.col(f"g{i}.mid") >= SUPPORT, F.col(f"g{i}")) for i in range(DEPTH, 0, -1)))
    # the last word by the two words before it, or the one; and how often texts end with them
    two = F.col("a2.mid") >= SUPPORT
    word = F.when(two, F.col("a1")).otherwise(F.col("a0"))
    final = F.coalesce(F.when(two, F.col("g3.final")), F.col("g2.final"), F.lit(0))
    # in a large corpus other texts stop within the same word, and some of them go on after it: only shares tell
    rare = (word["ended"] <= WHOLE * word["mid"]) & (F.col("named") | (final < SUPPORT) | (final <= word["mid"]))
    partial = F.coalesce((word["mid"] > 0) & rare, F.lit(False))
    told = wide.select("text_id", partial.alias("partial"), best.alias("b"))
    occurs = F.col("b.final") + F.col("b.ended") + F.col("b.mid")
    share = (F.col("b.final") + F.col("b.ended")) / occurs
    often = lambda places: (F.col("b.bare") >= SUPPORT) & (F.col("b.bare") > EXCESS * rate * places)
    natural = (share >= NATURAL) | often(F.col("b.mid"))
    state = F.when(F.col("partial"), "partial").when(F.col("b").isNull(), "unknown").when(natural, "end").otherwise("mid")
    told = told.select("text_id", state.alias("state"), F.coalesce(often(occurs), F.lit(False)).alias("known"), F.coalesce(share, F.lit(0.0)).alias("natural"))
    open_mid = F.col("core").rlike(OPEN)
    prefixes = continued(texts, ends.select("text_id", "core")).withColumn("continued", F.lit(True))
    rows = (
        ends.select("text_id", "mark", open_mid.alias("open_mid"), (F.length("core") < SHORT).alias("short")).join(told, "text_id", "left").join(prefixes, "text_id", "left")
        .select("text_id", "mark", F.when(F.col("open_mid"), "mid").otherwise(F.coalesce("state", F.lit("unknown"))).alias("state"), F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("natural", F.lit(0.0)).alias("natural"), F.coalesce("continued", F.lit(False)).alias("continued"), "short")
    )
    return rows.withColumn("continued", F.col("continued") & (~F.col("short") | (F.col("state") != "end"))).drop("short")


def source_limits(evidence: DataFrame) -> DataFrame:
    """(source, measure, limit, n): where lengths of cut texts (source, chars, bytes) of a source pile up.

    The measure with the larger pile counts, characters on a tie."""
    lengths = evidence.where(F.col("source").isNotNull()).select("source", F.explode(F.array(F.struct(F.lit("chars").alias("measure"), F.col("chars").alias("at")), F.struct(F.lit("bytes").alias("measure"), F.col("bytes").alias("at")))).alias("x")).select("source", "x.*")
    counted = lengths.groupBy("source", "measure", "at").agg(F.count(F.lit(1)).alias("n"))
    pile = counted.withColumn("pile", F.sum("n").over(Window.partitionBy("source", "measure").orderBy("at").rangeBetween(-SLACK, 0)))
    best = pile.groupBy("source").agg(F.max(F.struct("pile", F.col("measure").alias("measure"), (-F.col("at")).alias("below"))).alias("b"), F.sum(F.when(F.col("measure") == "chars", F.col("n"))).alias("n"))
    return best.where((F.col("b.pile") >= PILE) & (F.col("b.pile") * 2 >= F.col("n"))).select("source", F.col("b.measure").alias("measure"), (-F.col("b.below")).alias("limit"), F.col("b.pile").alias("n"))


def judged_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, source, cut, why) of every document with a text that is not blank."""
    docs = documents.select("doc_id", "source", "n_chars", "text").where(F.col("text").rlike(r"\S"))
    keyed = docs.select("doc_id", "source", "n_chars", F.md5("text").alias("text_id"), F.length("text").alias("chars"), F.octet_length("text").alias("bytes"), F.col("text").rlike("�\\s*$").alias("broken"))
    texts = stored(docs.groupBy("text").agg(F.count(F.lit(1)).alias("copies")).select(F.md5("text").alias("text_id"), "text"), "texts")
    seen = keyed.join(judged_endings(texts), "text_id", "left").drop("text_id")
    short = F.coalesce(F.col("n_chars") > F.col("bytes"), F.lit(False))
    goes_on = F.coalesce(F.col("state").isin("mid", "partial"), F.lit(False))
    seen = stored(seen.select("doc_id", "source", "chars", "bytes", "mark", "state", "known", "natural", (F.col("broken") | short).alias("reported"), F.coalesce("continued", F.lit(False)).alias("continued"), goes_on.alias("goes_on")), "seen")
    limits = source_limits(seen.where((F.col("goes_on") | F.col("continued")) & ~F.col("reported")))
    size = F.when(F.col("measure") == "bytes", F.col("bytes")).otherwise(F.col("chars"))
    at_limit = F.coalesce((size >= F.col("limit") - SLACK) & (size <= F.col("limit") + SLACK), F.lit(False)) & F.col("state").isNotNull()
    unusual = F.when(F.col("mark").isNotNull(), F.col("natural") < 0.9).otherwise((F.col("state") == "unknown") | ~F.col("known"))
    why = F.when(F.col("reported"), "report").when(F.col("continued"), "prefix").when(F.col("goes_on"), "ending").when(at_limit & unusual, "limit")
    judged = seen.join(limits.drop("n"), "source", "left").withColumn("why", why)
    return judged.select("doc_id", "source", F.col("why").isNotNull().alias("cut"), "why", "limit", "measure")


def cut_documents(documents: DataFrame) -> DataFrame:
    """(doc_id) of the documents whose text was cut."""
    return judged_documents(documents).where("cut").select("doc_id")


def source_report(documents: DataFrame) -> DataFrame:
    """Per source: texts, cut texts, their share, and the limit if one shows."""
    return judged_documents(documents).groupBy("source").agg(F.count(F.lit(1)).alias("n_texts"), F.sum(F.col("cut").cast("long")).alias("n_cut"), F.avg(F.col("cut").cast("double")).alias("share_cut"), F.max("limit").alias("limit"), F.max("measure").alias("measure"))
