import random

import pytest

from lanewright.llm import leaks, tokens, topn, truncation
from tests.conftest import rows

TEXTS = [None, "", " ", "a", "Hello  world\r\n\tagain", "<|endoftext|>", "naïve café 你好 🙂​ مرحبا", "x" * 5000, "ab" * 3000 + "́", "don't we'll I'm", "1234567890", "\n\n  \n"]


def test_tokens_equal_the_reference_tokenizer(spark):
    tokenizers = pytest.importorskip("tokenizers")
    P = pytest.importorskip("public_tokenizers")
    t = tokenizers.Tokenizer.from_file(str(P.path("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    assert tokens.SPLIT and tokens.ByteBpe(tokens.default_vocabulary()).encode(None) == []
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in tokens.encode_corpus(df).collect()}
    for i, x in enumerate(TEXTS):
        assert got[i] == t.encode(x or "", add_special_tokens=False).ids
    back = tokens.encode_corpus(df).withColumn("text", tokens.decode_column("ids"))
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: x or "" for i, x in enumerate(TEXTS)}
    assert tokens.encode_corpus(df.limit(0)).count() == 0


def test_top_n_matches_brute_force(spark):
    rng = random.Random(1)
    places = [(1, p, rng.randrange(30), rng.choice([1.0, 2.0, 0.5, None, float("nan"), -1.0]), 1) for p in range(3000)]
    places += rng.sample(places, 300) + [(2, 5, 7, 1.0, 1), (None, 1, 1, 1.0, 1), (1, None, 1, 1.0, 1), (1, 3, None, 1.0, 1)]
    bounds = [(1, 100 + i, 10 * i, 10 * i + rng.randrange(0, 9)) for i in range(100)] + [(1, 900, 1000, 3000), (2, 1, 0, 10), (1, 901, 5, 5), (1, 902, None, 9), (1, 903, 990, 1020)]
    p = spark.createDataFrame(places, "level_id long, item_pos long, item_id long, weight double, n_obs int")
    o = spark.createDataFrame(bounds, "level_id long, context_id long, start_pos long, stop_pos long")
    want = []
    for level, context, a, b in bounds:
        own = {(-w, x, pos, n) for lv, pos, x, w, n in places if lv == level and None not in (a, b, pos, x, w) and w == w and a <= pos < b}
        want += [(level, context, i + 1, x) for i, (_, x, *_) in enumerate(sorted(own)[:5])]
    assert sorted(rows(topn.top_per_context(p, o))) == sorted(want)
    assert topn.top_per_context(p.limit(0), o).count() == 0


def test_loser_tree_merges_and_skips():
    rng = random.Random(2)
    for k in (0, 1, 2, 3, 5, 8):
        runs = [sorted(((rng.randrange(4),), rng.random()) for _ in range(rng.randrange(0, 30))) for _ in range(k)]
        coded = []
        for run in runs:
            nexts = [next((j for j in range(i, len(run)) if run[j][0] != run[i][0]), len(run)) for i in range(len(run))]
            coded.append((run, nexts))
        got = [key for _, key in topn.LoserTree(coded).first(3)]
        flat = sorted(x for run in runs for x in run)
        assert got == [x for g in range(4) for x in [y for y in flat if y[0] == (g,)][:3]]


def brute_leaks(docs, items, n=12):
    out = set()
    for d, text in docs:
        w = leaks.words(text or "")
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for b, item in items:
            v = leaks.words(item or "")
            if any(tuple(v[i : i + n]) in grams for i in range(len(v) - n + 1)):
                out.add((d, b))
    return out


def test_leaks_match_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(25)]
    items = [(b, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 40)))) for b in range(12)] + [(50, None), (51, "")]
    docs = []
    for d in range(150):
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))]
        if d % 3 == 0:
            v = leaks.words(items[rng.randrange(12)][1])
            a = rng.randrange(0, max(1, len(v) - 10))
            text[5:5] = v[a : a + rng.choice([11, 12, 13, 40])]
        docs.append((d, rng.choice([" ", ", ", " -- ", "_", "\n"]).join(w.upper() if rng.random() < 0.2 else w for w in text)))
    docs += [(900, None), (901, ""), (902, docs[0][1])]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, bench_id int")
    b = spark.createDataFrame(items, "bench_id long, text string")
    found = leaks.leaks(d, b)
    want = brute_leaks(docs, items)
    assert want and set(rows(found, "doc_id", "bench_id")) == want
    longest = {(r["doc_id"], r["bench_id"]): r["n_words"] for r in found.collect()}
    for (i, j), n in longest.items():
        w, v = leaks.words(dict(docs)[i]), leaks.words(dict(items)[j])
        grams = lambda x, k: {tuple(x[a : a + k]) for a in range(len(x) - k + 1)}
        assert grams(w, n) & grams(v, n) and not grams(w, n + 1) & grams(v, n + 1)
    assert set(rows(leaks.leaks(d, b, block_chars=300), "doc_id", "bench_id")) == want
    own = leaks.TestSet([(i, t) for i, t in items], 12)
    texts = [(i, [own.ids.get(w, 0) for w in leaks.words(t)]) for i, t in docs if t]
    whole = leaks._matches(own, *map(list, zip(*texts))).to_pylist()
    monkeypatch.setattr(leaks, "HITS", 3)
    assert leaks._matches(own, *map(list, zip(*texts))).to_pylist() == whole
    assert leaks.without_leaks(d, found).count() == len(docs) - len({i for i, _ in want})
    assert leaks.leaks(d.limit(0), b).count() == 0 and leaks.leaks(d, b.limit(0)).count() == 0


def corpus():
    rng = random.Random(4)
    who = ["the carry", "a careful support", "the losing side", "our front line"]
    does = ["leans on the soul lead", "skips the lane bonus", "tests a movement purchase", "drops every flex slot"]
    when = ["late in the game", "near the bridge", "with a full purse", "once the guardians fall"]
    sentence = lambda: f"{rng.choice(who).capitalize()} {rng.choice(does)} {rng.choice(when)}."
    return [" ".join(sentence() for _ in range(rng.randrange(4, 12))) for _ in range(400)]


def test_truncation(spark):
    whole = corpus()
    docs, cut = [], set()
    for i, text in enumerate(whole):
        docs.append((i, text, f"feed{i % 5}", len(text)))
        if i % 4 == 0:  # a feed that keeps 150 characters
            docs.append((1000 + i, text[:150], "short", 150))
            if not text[:150].rstrip().endswith(".") and len(text) > 150:
                cut.add(1000 + i)
    docs += [(5000, whole[1][:-20], "feed1", len(whole[1])), (5001, whole[2] + " and so on…", "feed2", None), (5002, whole[3][:77] + "�", "feed3", 77), (5003, None, "feed1", 5), (5004, "", "feed1", 0), (5005, "  \n", None, 3)]
    docs += [(6000 + i, whole[i] + "\n\n— the desk", "feed4", None) for i in range(20)]
    cut |= {5000, 5002}
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, source string, n_chars long, text_id string")
    got = {r["doc_id"] for r in truncation.cut_documents(df).collect()}
    assert len(got - cut) <= 1 and len(cut - got) <= 2
    report = {r["source"]: r for r in truncation.source_report(df).collect()}
    assert report["short"]["limit"] == 150 and report["short"]["n_cut"] >= len(cut) - 4
    assert truncation.cut_documents(df.limit(0)).count() == 0


def test_truncation_where_many_texts_stop_at_one_place(spark):
    # in a large corpus several texts stop within the same word, with a mark and without, or between the same words
    whole = corpus()
    docs = [(i, text, f"feed{i % 5}") for i, text in enumerate(whole)]
    docs += [(1000 + i, whole[i] + "\n\n— the desk", "signed") for i in range(200)]
    begun = [(2000 + i, whole[i] + " The carry leans on the sou", f"feed{i % 5}") for i in range(30)]
    begun += [(3000 + i, whole[40 + i] + " The carry leans on the sou" + mark, f"feed{i % 5}") for i, mark in enumerate(("…", "...", " (more)", " [...]") * 3)]
    begun += [(3100 + i, whole[60 + i] + "</p", f"feed{i % 5}") for i in range(10)]
    limited = []
    for i in range(24):
        end = " Our front line drops every flex slot late in the game" if i % 3 == 0 else " The losing side tests a movement pur"
        limited.append((4000 + i, whole[100 + i].ljust(300, "x")[: 300 - len(end) - 1] + "." + end, "short"))
    docs += begun + limited
    df = spark.createDataFrame([(i, text, source, None) for i, text, source in docs], "doc_id long, text string, source string, n_chars long")
    got = {r["doc_id"] for r in truncation.cut_documents(df).collect()}
    assert got == {i for i, *_ in begun + limited}


def test_prefix_sweep_matches_brute_force(spark):
    rng = random.Random(5)
    texts = sorted({"".join(rng.choice("ab c") for _ in range(rng.randrange(1, 9))) for _ in range(300)})
    cores = texts[::3]
    t = spark.createDataFrame([(str(i), x) for i, x in enumerate(texts)], "text_id string, text string").repartition(7)
    c = spark.createDataFrame([(f"c{i}", x) for i, x in enumerate(cores)], "text_id string, core string")
    want = {f"c{i}" for i, x in enumerate(cores) if any(y.startswith(x) and truncation._goes_on(x, y) for y in texts)}
    assert {r["text_id"] for r in truncation.continued(t, c).collect()} == want


@pytest.mark.parametrize("block_chars", [20, 20_000_000])
def test_prefixes_are_found_across_partitions(spark, block_chars):
    # a core, texts that start with it and stop there, and far behind them the one that goes on
    texts = sorted({f"the lane {i:03d} was lost" + tail for i in range(12) for tail in (*(f" - {j:03d}." for j in range(40)), "z again.")} | {"the lane 003 was lost, the lane 003 was"})
    cores = [f"the lane {i:03d} was lost" for i in range(12)] + ["the lane", "the lane 003 was lost, the lane", "the lane 004 was lost - 039", "the lane 0"]
    t = spark.createDataFrame([(str(i), x) for i, x in enumerate(texts)], "text_id string, text string")
    c = spark.createDataFrame([(f"c{i}", x) for i, x in enumerate(cores)], "text_id string, core string")
    want = {f"c{i}" for i, x in enumerate(cores) if any(y.startswith(x) and truncation._goes_on(x, y) for y in texts)}
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "48"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = {r["text_id"] for r in truncation.continued(t, c, block_chars).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == want


def brute_counts(texts):
    """(final, ended, mid) of every context and every word or beginning of a word in context, by plain strings."""
    counts = {}

    def add(key, column):
        counts.setdefault(key, [0, 0, 0])[column] += 1

    for text in texts:
        out, raw, begins = [], [], True
        for w in truncation.TOKEN.findall(text):
            add("positions", 2)
            if w[0] in "\r\n" or (w[0] == "<" and len(w) > 2):
                out, raw, begins = [*out, "\n"], [*raw, None], True
            elif w in truncation.STOPS:
                out, raw, begins = [*out, w], [*raw, None], True
            else:
                number = any(map(str.isdigit, w))
                out, raw, begins = [*out, "#" if number else "N" if w[0].isupper() and not begins else w.lower()], [*raw, None if number else w.lower()], False
        for i, t in enumerate(out):
            bound = lambda k: k < 0 or out[k] == "\n" or out[k] in truncation.STOPS
            if bound(i):
                continue
            if i < len(out) - 1:
                p = out[i - 1] if i and out[i - 1] not in truncation.STOPS else "^"
                q = "" if p == "^" else out[i - 2] if i > 1 and out[i - 2] not in truncation.STOPS else "^"
                if raw[i]:
                    add(("p", q, p), 2)
                    for lead in (("1", p), ("2", q, p)):
                        add((*lead, raw[i]), 1)
                        for j in range(1, len(raw[i])):
                            add((*lead, raw[i][:j]), 2)
                if t == "N" and out[i + 1] == "N":
                    continue
            last, k, grams = [], i, 0
            while grams < truncation.DEPTH:
                if bound(k):
                    add(("g", "^", *last), 0 if i == len(out) - 1 else 1 if bound(i + 1) else 2)
                    break
                if not (out[k] == "N" and last and last[-1] == "N"):
                    last.append(out[k])
                    add(("g", *last), 0 if i == len(out) - 1 else 1 if bound(i + 1) else 2)
                    grams += 1
                k -= 1
    return counts


def test_context_counts_match_brute_force():
    rng = random.Random(6)
    words = ["the", "Lane", "Guard", "a", "ab", "abc", "7", "x2", ".", "!", "\n", "<b>", ",", "_", "…", "it's"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 25))) for _ in range(300)]
    lexicon, counts = truncation.Lexicon(), truncation.Counts()
    for lo in range(0, 300, 70):
        truncation._counted(truncation.Tokens(texts[lo : lo + 70], lexicon), lexicon, counts)
    got = counts.summed()
    want = brute_counts(texts)
    assert sorted(zip(*(got.column(c).to_pylist() for c in ("final", "ended", "mid")))) == sorted(map(tuple, want.values()))
