"""Operators of the llm subpackage against brute force, round trips and odd inputs."""

from __future__ import annotations

import base64
import hashlib
import io
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from tracewright.llm import ann, bytebpe, common, components, cotrain, decontam, licences, linechunks, lmscore, ngramjoin, shingles, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
ODD = [None, "", " ", "one", "a\nb", "é ñ ß 中 🙂", "x" * 30_000, "w " * 4000, "\n\n\n"]


def documents(spark, texts, start=1):
    rows = [(k, t, "en", "s", len(t) if t else None) for k, t in enumerate(texts, start)]
    return spark.createDataFrame(rows, DOCS)


def odd(spark):
    """Odd texts, a null id, a repeated row and columns whose names clash."""
    df = documents(spark, ODD).union(spark.createDataFrame([(None, "no id at all here", None, None, None), (4, "one", "en", "s", 3)], DOCS))
    return df.withColumns({c: F.lit(1) for c in ("score", "th", "n_words", "fp", "tokens", "h", "at", "pos", "n", "token", "ids", "__text", "n_removed", "keep")})


def words(n, seed, size=400):
    r = random.Random(seed)
    return [f"w{r.randrange(size)}" for _ in range(n)]


# byte-level BPE


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bytebpe.load_ranks(PATH), special_tokens={})


def test_bpe_equals_the_tokenizer(encoding):
    r = random.Random(5)
    alphabet = "ab 'tslé\n\t 12,.!?ñ中文🙂 \x1c\x00ıſaaa   "
    texts = [t for t in ODD if t is not None] + ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(1500)]
    for t in texts:
        ids = bytebpe.encode(t, PATH, PATTERN)
        assert ids == encoding.encode_ordinary(t), repr(t)
        assert bytebpe.decode(ids, PATH) == t.encode()


def test_bpe_rows(spark, encoding):
    got = bytebpe.op4_byte_bpe(odd(spark), PATH, PATTERN, ids=True).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        assert hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest() == r.ids_sha256 and r.n_tokens == len(r.ids)
    assert sum(r.n_tokens == 0 for r in got) == 2
    assert bytebpe.op4_byte_bpe(documents(spark, []), PATH, PATTERN).count() == 0


def test_idle_workers_keep_no_caches(spark):
    texts = [" ".join(words(20, k, 9000)) + f" only{k}" for k in range(1300)]
    got = bytebpe.op4_byte_bpe(documents(spark, texts).repartition(1), PATH, PATTERN, ids=True).collect()
    assert sorted((g.doc_id, g.ids) for g in got) == [(k, bytebpe.encode(t, PATH, PATTERN)) for k, t in enumerate(texts, 1)]

    def held(batches):
        for b in batches:
            kept = [len(v._new) + len(v._old) + len(v._pair) for v in bytebpe._LOADED.values()]
            yield pa.RecordBatch.from_arrays([pa.array([len(kept)]), pa.array([sum(kept)])], ["loaded", "kept"])

    # workers are used again, so some of these tasks run where the texts were encoded
    found = spark.range(0, 64, 1, 16).mapInArrow(held, "loaded long, kept long").collect()
    assert sum(r.loaded for r in found) > 0 and sum(r.kept for r in found) == 0


def test_a_task_gives_back_what_it_freed(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append("back"))
    run = common.tidy(lambda batches: (b + 1 for b in batches), lambda: calls.append("forget"))
    assert list(run(iter([1, 2]))) == [2, 3] and calls == ["forget", "back"]
    part = run(iter([1, 2]))
    assert next(part) == 2
    part.close()  # as a limit does
    assert calls == ["forget", "back"] * 2


def test_bpe_appends_and_edits():
    v, r = bytebpe.loaded(PATH), random.Random(2)
    for _ in range(60):
        data = bytes(r.choice(b"abcdeth ing") for _ in range(200))
        table = bytebpe.PrefixTable(v, data[:70])
        table.append(data[70:])
        assert table.ids() == v.ids(data)
        a = r.randrange(190)
        b, new = a + r.randrange(9), bytes(r.choice(b"xyz the") for _ in range(r.randrange(6)))
        table.replace(a, b, new)
        assert table.ids() == v.ids(data[:a] + new + data[b:])


def test_pair_rule_equals_merging():
    v, r = bytebpe.loaded(PATH), random.Random(3)
    ranks = [x for x in r.sample(sorted(v.bytes_of), 400) if len(v.bytes_of[x]) == 1 or v.halves(x)]
    for a, b in zip(ranks, ranks[1:], strict=False):
        assert v.follows(a, b) == (v.merged(v.bytes_of[a] + v.bytes_of[b]) == [a, b])


# toxicity


def test_folding():
    assert toxicity.fold("1D10T") == toxicity.fold("idiot") == toxicity.fold("іdіоt") == toxicity.fold("ïdí​òt")


def test_exceptions_and_longest_terms():
    a = toxicity.automaton(toxicity.Lexicon({"trash": 2.0, "trashy": 3.0}, ("trash can",)))
    assert toxicity.weigh("the trash can and trash", a) == (1, 2.0)
    assert toxicity.weigh("trashy", a) == (1, 3.0)
    assert toxicity.weigh("untrash", a) == (0, 0.0)


def test_toxicity_learns_from_the_training_fold_only(spark):
    r = random.Random(1)
    rows, marks = [], []
    for k in range(600):
        bad = k % 6 == 0
        w = words(40, k, 5000)
        if bad:
            w[r.randrange(40)] = r.choice(["vileword", "v1leword", "grubox"]) + r.choice(["", "er", "ing"])
        rows.append(" ".join(w))
        marks.append((k + 1, 1, int(bad)))
    docs, labels = documents(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.op3_toxicity(docs, labels).collect()}
    assert all(g.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, g in got.items())
    assert np.mean([got[i].predicted == y for i, _, y in marks if got[i].held_out]) > 0.97
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and 480 < kept.count() < 530


def test_toxicity_without_labels_and_with_odd_texts(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.op3_toxicity(odd(spark), none).collect()
    assert len(got) == len(ODD) + 2 and all(r.score == 0.0 and r.predicted == 0 for r in got)
    some = spark.createDataFrame([(4, 1, 1), (4, 1, 0), (None, 1, 1), (5, 1, None), (6, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.op3_toxicity(odd(spark), some).count() == len(ODD) + 2


# decontamination


def brute_decontam(docs, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for d, t in docs:
        w, hit, names = split(t), set(), set()
        for name, text in items:
            iw = split(text)
            n = min(10, len(iw))
            for i in range(len(iw) - n + 1 if iw else 0):
                for k in range(len(w) - n + 1):
                    if w[k : k + n] == iw[i : i + n]:
                        hit |= set(range(k, k + n))
                        names.add(name)
        ids = ",".join(sorted(map(str, names)))
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_decontamination_against_brute_force(spark):
    items = [(k, " ".join(words(n, 50 + k, 60))) for k, n in enumerate((25, 12, 10, 4, 2, 1, 3))] + [(90, None), (91, "Ünï-Ça dé fé"), (92, " ".join(words(12, 51, 60)))]
    docs = [(k, " ".join(words(60, k, 60))) for k in range(25)]
    docs += [(100 + k, " ".join(words(20, k, 60)) + ", " + (t or "").upper() + "; " + (t or "") + " " + " ".join(words(9, k, 60))) for k, (_, t) in enumerate(items)] + [(200, None), (201, "")]
    got = decontam.op7_decontam(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == brute_decontam(docs, items)
    few = decontam.op7_decontam(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), broadcast_rows=0)
    assert sorted(tuple(r) for r in few.collect()) == brute_decontam(docs, items)


def test_decontamination_of_odd_and_empty_tables(spark):
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    got = decontam.op7_decontam(odd(spark), items)
    assert got.count() == len(ODD) + 2 and got.where("contaminated").count() == 2
    assert decontam.op7_decontam(odd(spark), items.limit(0)).where("n_hit > 0").count() == 0
    assert decontam.op7_decontam(documents(spark, []), items).count() == 0
    assert decontam.drop_contaminated(odd(spark), items).count() == len(ODD)


# n-gram join


def brute_components(texts):
    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {k: grams(t) for k, t in texts}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((k, len(sets[k]), find(k)) for k in keys)


def test_ngram_join_against_brute_force(spark):
    r = random.Random(8)
    texts = []
    for g in range(12):
        base = words(r.choice((6, 30, 90, 200)), g, 3000)
        for _ in range(r.choice((1, 2, 12, 40))):
            w = list(base)
            for _ in range(r.choice((0, 0, 1, 2, 3, 5))):
                w[r.randrange(len(w))] = f"z{r.randrange(10**6)}"
            texts.append(" ".join(w))
    passage = " ".join(words(60, 99, 3000))
    texts += [" ".join(words(70, 1000 + k, 3000)) + " " + passage for k in range(90)]
    texts += [" ".join(words(k % 22, 2000 + k, 3000)) + " " + passage for k in range(90)] + ["", None, "a", "A", "b c"]
    rows = list(enumerate(texts))
    got = ngramjoin.op8_ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id"))
    assert sorted(tuple(x) for x in got.collect()) == brute_components(rows)


def test_frequent_ngrams_and_small_batches(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "FREQUENT", 4)
    base = words(80, 5, 3000)
    rows = [(k, " ".join([*base[:60], *words(k % 25, k, 3000)])) for k in range(60)]
    assert sorted(tuple(x) for x in ngramjoin.op8_ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == brute_components(rows)


def test_fragments_keep_ngrams_apart():
    t = np.sort(np.random.default_rng(1).integers(0, 1 << 64, 5000, dtype=np.uint64))
    for n in (1, 8, 1000):
        cut = ngramjoin.Fragments(n)
        whole = cut.whole(t)
        edges = [0, *np.searchsorted(t, [cut.low(k) for k in range(1, n)]), len(t)]
        back = np.concatenate([cut.unpack(k, cut.pack(k, t[a:b])) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))])
        assert (back == whole).all() and len(np.unique(whole)) == len(t)


def test_ngram_join_of_odd_and_empty_tables(spark):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngramjoin.op8_ngram_join(odd(spark)).collect()}
    assert (1, 0, 1) in got and (4, 1, 4) in got and (None, 1, None) in got
    assert ngramjoin.op8_ngram_join(documents(spark, [])).count() == 0
    assert ngramjoin.one_of_each(documents(spark, ["a b c", "A b c", None, "", "d"])).count() == 4


def test_sets_that_share_a_little_have_no_partner(spark):
    shared = words(6, 77, 3000)
    rows = [(k, " ".join([*words(40, 500 + k, 9000), *shared])) for k in range(2)]
    assert sorted(tuple(x) for x in ngramjoin.op8_ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == brute_components(rows)


def test_long_sets_are_cut_and_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "SEGMENT", 50)
    monkeypatch.setattr(ngramjoin, "BROADCAST_PAIRS", 0)
    r, rows = random.Random(3), []
    for g, n in enumerate((40, 120, 500, 2000)):
        base = words(n, 900 + g, 9000)
        for k in range(6):
            w = list(base)
            for _ in range(n * k // 100):
                w[r.randrange(n)] = f"z{r.randrange(10**6)}"
            rows.append((100 * g + k, " ".join(w[: n - k])))
    assert sorted(tuple(x) for x in ngramjoin.op8_ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == brute_components(rows)


def test_one_of_each_keeps_other_texts_of_an_id(spark, monkeypatch):
    texts = [(5, "alpha beta gamma"), (5, "delta epsilon"), (7, "alpha beta gamma"), (7, "other words here"), (7, "Other words here"), (7, "other words here"), (None, "delta epsilon"), (None, "alone without id"), (None, None), (9, ""), (9, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t) if t else None) for d, t in texts], DOCS)
    want = [(5, "alpha beta gamma"), (5, "delta epsilon"), (7, "other words here"), (9, ""), (9, ""), (None, None), (None, "alone without id")]
    for drops in (1_000_000, 0):
        monkeypatch.setattr(ngramjoin, "BROADCAST_DROPS", drops)
        got = [(r.doc_id, r.text and r.text.lower()) for r in ngramjoin.one_of_each(docs).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))


def test_components_of_chains(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 102), (101, 102)], "a long, b long")
    got = {r.node: r.comp for r in components.components(links).collect()}
    assert all(got[k] == 0 for k in range(41)) and got[102] == 100


# line dedup


def brute_lines(rows):
    seen, out = set(), {}
    for d, t in sorted(rows):
        lines, kept = linechunks._split(t), []
        for lo, hi in linechunks.chunks(lines):
            chunk = b"\n".join(lines[lo:hi])
            if hi - lo >= linechunks.LEAST and t:
                if chunk in seen:
                    continue
                seen.add(chunk)
            kept += lines[lo:hi]
        out[d] = b"\n".join(kept).decode() if t is not None else None
    return out


def test_line_dedup_against_brute_force(spark):
    r = random.Random(4)
    passages = [[" ".join(words(8, 31 * p + k)) for k in range(12)] for p in range(6)]
    rows = []
    for d in range(80):
        lines = [" ".join(words(6, 10_000 + 50 * d + k)) for k in range(r.randrange(1, 12))]
        at = r.randrange(len(lines) + 1)
        rows.append((d, "\n".join(lines[:at] + (r.choice(passages) if d % 2 else []) + lines[at:])))
    got = linechunks.remove_repeated(documents(spark, [t for _, t in rows], 0))
    assert {x.doc_id: x.text for x in got.collect()} == brute_lines(rows)
    assert {x.doc_id: x.text for x in linechunks.remove_repeated(documents(spark, [t for _, t in rows], 0), broadcast_places=0).collect()} == brute_lines(rows)
    assert got.where("n_removed > 0").count() > 20 and got.where("n_removed > 0 and n_chars <> length(text)").count() == 0


def test_planted_passages_go_whole(spark):
    texts, want = [], []
    for k in range(60):
        passage = [" ".join(words(9, 70_000 + 20 * k + j, 9000)) for j in range(4 + k % 9)]
        if k % 6 == 5:
            passage = [" ".join(passage)] if len(passage) > 5 else ["\n\n".join(passage)]
        for copy in range(2):
            around = [[" ".join(words(9, 200_000 + 100 * k + 50 * copy + 25 * side + j, 9000)) for j in range(3)] for side in (0, 1)]
            texts.append("\n".join([*around[0], *passage, *around[1]]))
            want.append("\n".join([*around[0], *([] if copy else passage), *around[1]]))
    for places in (1_000_000, 0):
        got = {r.doc_id: r.text for r in linechunks.remove_passages(documents(spark, texts), places).collect()}
        assert [got[k] for k in range(1, len(texts) + 1)] == want
    lines = {r.doc_id: r.n_lines for r in linechunks.op2_line_dedup(documents(spark, texts)).collect()}
    assert [lines[k] for k in range(1, len(texts) + 1)] == [len(t.split("\n")) for t in want]
    same = linechunks.remove_passages(documents(spark, ["x y\nx y\nx y\nx y", "p\nq", "p\nr"])).orderBy("doc_id").collect()
    assert [r.text for r in same] == ["x y", "p\nq", "p\nr"]


def test_short_passages_of_fifty_words_go_whole(spark):
    texts, want = [], []
    shapes = [(45, 6), (6, 45), (20, 20, 12), (5, 5, 45), (14, 24, 13), (17, 17, 17), (51,), (13, 13, 13, 13), (1, 40, 1, 10)]
    for k in range(45):
        passage = [" ".join(words(n, 900_000 + 10 * k + j, 9000)) for j, n in enumerate(shapes[k % len(shapes)])]
        for copy in range(2):
            around = [[" ".join(words(7 + (k * copy) % 5, 500_000 + 100 * k + 50 * copy + 25 * side + j, 9000)) for j in range(1 + k % 4)] for side in (0, 1)]
            texts.append("\n".join([*around[0], *passage, *around[1]]))
            want.append("\n".join([*around[0], *([] if copy else passage), *around[1]]))
    got = {r.doc_id: r.text for r in linechunks.remove_passages(documents(spark, texts)).collect()}
    assert [got[k] for k in range(1, len(texts) + 1)] == want


def test_equal_digests_of_other_bytes_remove_nothing(spark):
    passage = ["one of the lines", "that occur again", "in other documents", "and go there"]
    texts = ["\n".join([f"only {k} a", f"only {k} b", *(passage if k % 2 else []), f"only {k} c"]) for k in range(8)]
    want = {r.doc_id: r.text for r in linechunks.remove_passages(documents(spark, texts)).collect()}
    assert want[2] == texts[1] and want[4] == "only 3 a\nonly 3 b\nonly 3 c"
    for same in (lambda part, body: b"0" * 16, lambda part, body: bytes([len(body) % 3]) * 16):
        assert {r.doc_id: r.text for r in linechunks.remove_passages(documents(spark, texts), digest=same).collect()} == want


def test_boundaries_resist_shifts():
    lines = [f"line {k}".encode() for k in range(300)]
    ends = {lines[hi - 1] for _, hi in linechunks.chunks(lines)}
    moved = {x for x in (([b"new"] + lines)[hi - 1] for _, hi in linechunks.chunks([b"new", *lines]))}
    assert len(ends & moved) > 0.9 * len(ends)


def test_line_dedup_of_odd_and_empty_tables(spark):
    got = linechunks.op2_line_dedup(odd(spark))
    assert got.count() == len(ODD) + 2 and got.where("n_removed > 0").count() == 0
    assert linechunks.op2_line_dedup(documents(spark, [])).count() == 0


# co-training, licences, LM scores


def test_cotraining_tells_junk(spark):
    good = [" ".join(words(50, k)) + "." for k in range(300)]
    junk = [" ".join(f"{w}%%%" for w in words(50, k)) for k in range(60)] + [("again " * 60).strip()] * 40
    docs = documents(spark, good + junk)
    labels = spark.createDataFrame([(k + 1, int(k < 300), 0) for k in range(400) if k % 2], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in cotrain.op1_cotrain(docs, labels).collect()}
    assert np.mean([got[k + 1].predicted == int(k < 300) for k in range(400)]) > 0.97
    none = cotrain.op1_cotrain(odd(spark), labels.limit(0)).collect()
    assert len(none) == len(ODD) + 2 and all(r.score == 0.5 for r in none)
    assert cotrain.op1_cotrain(documents(spark, []), labels).count() == 0


def test_cotraining_counts_words_and_keeps_rows_for_the_curves(spark):
    r = random.Random(5)
    good = [" ".join(f"fine{r.randrange(40)}" if r.random() < 0.3 else f"w{r.randrange(4000)}" for _ in range(60)) for _ in range(300)]
    poor = [" ".join(f"poor{r.randrange(40)}" if r.random() < 0.3 else f"w{r.randrange(4000)}" for _ in range(60)) for _ in range(300)]
    docs = documents(spark, good + poor)
    labels = spark.createDataFrame([(k + 1, int(k < 300), 0) for k in range(600) if k % 2], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in cotrain.op1_cotrain(docs, labels).collect()}
    assert np.mean([got[k + 1].predicted == int(k < 300) for k in range(600)]) > 0.97
    # the counts of a model against plain counting, over shape and words
    rows = cotrain.features(docs).join(labels.select("doc_id", F.col("quality").alias("y")), "doc_id", "left")
    model = cotrain._text_model(rows, "y")
    n = np.ones((2, cotrain.WORD_BINS))
    for k, t in enumerate(good + poor):
        if k % 2:
            n[int(k < 300), cotrain.word_bins(t)] += 1
    assert np.allclose(model.words, np.log(n[1] / n[1].sum()) - np.log(n[0] / n[0].sum()))
    odd_rows = cotrain.op1_cotrain(odd(spark).union(docs.withColumns({c: F.lit(1) for c in odd(spark).columns[5:]})), labels).collect()
    assert len(odd_rows) == len(ODD) + 2 + 600 and all(0 <= x.score <= 1 for x in odd_rows)


def test_a_licence_inside_one_line_and_whole_texts():
    scanner = licences.Scanner(licences.TEMPLATES)
    for name, forms in licences.TEMPLATES.items():
        text = " ".join(words(40, 1)) + " " + forms[-1] + " " + " ".join(words(40, 2))
        assert name in {x[0] for x in scanner.scan_words(text)}


def brute_licences(text, templates, t):
    found = {}
    lines = (text or "").split("\n")
    for lo in range(len(lines)):
        for hi in range(lo, len(lines)):
            grams = licences.bigrams(licences.words("\n".join(lines[lo : hi + 1])))
            for name, forms in templates.items():
                for form in forms:
                    d = licences.dice(grams, licences.bigrams(licences.words(form)))
                    if d >= t:
                        found[name] = max(found.get(name, 0), d)
    return {k: round(v, 9) for k, v in found.items()}


def test_licences_against_brute_force(spark):
    r, texts = random.Random(6), list(ODD)
    forms = [f for fs in licences.TEMPLATES.values() for f in fs]
    for k in range(80):
        w = r.choice(forms).split(" ")
        for _ in range(r.randrange(3)):
            w[r.randrange(len(w))] = "other"
        for _ in range(r.randrange(3)):
            w.insert(r.randrange(len(w)), "\n")
        texts.append(" ".join(words(8, k)) + "\n" + " ".join(w) + "\n" + " ".join(words(5, k)))
    s = licences.Scanner(licences.TEMPLATES)
    for x in texts:
        assert {n: round(d, 9) for n, d, _, _ in s.scan(x)} == brute_licences(x, licences.TEMPLATES, licences.THRESHOLD), x
    got = licences.op5_licences(odd(spark))
    assert got.count() == len(ODD) + 2 and got.where("n_licences > 0").count() == 0
    assert licences.op5_licences(documents(spark, [])).count() == 0


def test_licences_inside_lines(spark):
    r, templates = random.Random(12), licences.TEMPLATES
    forms = [(n, f) for n, fs in templates.items() for f in fs]
    texts = ["Docs: Licensed under CC BY 4.0 as stated in the file.", "one line " * 3000 + forms[3][1] + " tail" * 3000, "a b\nfoo Licensed under\nCC BY 4.0 bar"]
    for k in range(25):
        w = r.choice(forms)[1].split(" ")[:30]
        w[r.randrange(len(w))] = r.choice(["other", "the", "License"])
        texts.append(" ".join([*words(4, k), *w, *words(5, k + 50)]))
    s = licences.Scanner(templates)
    for x in [*texts[:1], *texts[2:]]:
        want, w = {}, licences.words(x)
        for lo in range(len(w)):
            for hi in range(lo + 1, len(w) + 1):
                grams = licences.bigrams(w[lo:hi])
                for name, form in forms:
                    d = licences.dice(grams, licences.bigrams(licences.words(form)))
                    if d >= licences.THRESHOLD:
                        want[name] = max(want.get(name, 0), d)
        assert {n: round(d, 9) for n, d, _, _ in s.scan_words(x)} == {n: round(d, 9) for n, d in want.items()}, x
    got = {x.doc_id: x for x in licences.op5_licences(documents(spark, texts)).collect()}
    assert (got[1].best, got[1].dice, got[2].best, got[2].dice) == ("CC-BY-4.0", 1.0, forms[3][0], 1.0)
    assert (got[3].best, got[3].first_line, got[3].last_line) == ("CC-BY-4.0", 1, 2)
    assert licences.Scanner({"x": ["solo"]}).scan_words("a\nb solo c") == [("x", 1.0, 1, 1)]


def test_lm_scores_against_counting(spark):
    texts = [" ".join(words(30, k, 40)) for k in range(40)] + [" ".join(words(30, k, 4000)) for k in range(40)]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(k + 1, int(k < 40), 0) for k in range(80)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in lmscore.op6_lm_score(docs, labels).collect()}

    def model(part):
        one, two, ctx = {}, {}, {}
        for t in part:
            w, p = lmscore._slots(t)
            for a, b, c in zip(w, p, lmscore._contexts(w), strict=True):
                one[a], two[b], ctx[c] = one.get(a, 0) + 1, two.get(b, 0) + 1, ctx.get(c, 0) + 1
        return one, two, ctx, sum(one.values())

    def loss(m, t):
        w, p = lmscore._slots(t)
        out = []
        for a, b, c in zip(w, p, lmscore._contexts(w), strict=True):
            n = m[2].get(c, 0)
            out.append(-np.log2(lmscore.WEIGHT * min(m[1].get(b, 0), n) / max(n, 1) + (1 - lmscore.WEIGHT) * (m[0].get(a, 0) + 1) / (m[3] + (1 << lmscore.WORD_BITS))))
        return np.mean(out)

    target, background = model(texts[:40]), model(texts)
    for k in (0, 7, 41, 79):
        assert abs(got[k + 1].score - (loss(target, texts[k]) - loss(background, texts[k]))) < 1e-9
    assert np.mean([got[k].score for k in range(1, 41)]) < np.mean([got[k].score for k in range(41, 81)])
    assert lmscore.op6_lm_score(odd(spark), labels).where("score is null").count() == 4
    assert lmscore.op6_lm_score(documents(spark, []), labels.limit(0)).count() == 0


def test_lm_counts_are_exact_at_any_size(spark):
    r = random.Random(9)
    texts = [" ".join(f"v{r.randrange(200_000)}" for _ in range(600)) for _ in range(400)] + ["the same here " * k for k in (1, 5, 90)]
    docs = documents(spark, [*texts, texts[0]]).union(documents(spark, texts[1:2], 2))
    labels = spark.createDataFrame([(k + 1, int(k % 3 == 0), 0) for k in range(300)] + [(1, 0, 0)], "doc_id long, quality int, toxic int")
    rows = [(x.doc_id, x.text) for x in docs.collect()]

    def model(part):
        one, two, ctx = {}, {}, {}
        for t in part:
            w = [None, *t.split()]
            for a, b in zip(w, w[1:], strict=False):
                one[b], two[a, b], ctx[a] = one.get(b, 0) + 1, two.get((a, b), 0) + 1, ctx.get(a, 0) + 1
        return one, two, ctx, sum(one.values())

    background, target = model([t for _, t in rows]), model([t for d, t in rows if d <= 300 and (d - 1) % 3 == 0])
    assert len(background[0]) > 1 << lmscore.WORD_BITS

    def loss(m, t):
        w = [None, *t.split()]
        return np.mean([-np.log2(0.7 * m[1].get((a, b), 0) / max(m[2].get(a, 0), 1) + 0.3 * (m[0].get(b, 0) + 1) / (m[3] + len(background[0]))) for a, b in zip(w, w[1:], strict=False)])

    for options in ({}, {"fragment_chars": 100_000, "broadcast_rows": 0}):
        got = lmscore.op6_lm_score(docs, labels, **options).collect()
        assert sorted(x.doc_id for x in got) == sorted(d for d, _ in rows)
        for x in got[::7] + [x for x in got if x.doc_id == 2]:
            t = texts[(x.doc_id - 1) % len(texts)]
            assert x.n_tokens == len(t.split()) and abs(x.target_loss - loss(target, t)) < 1e-9 and abs(x.background_loss - loss(background, t)) < 1e-9


def test_shingle_hashes_are_as_many_as_shingles():
    texts = [t for t in ODD] + ["\x0b".join(words(40, 3)), "A a A a A a A a"]
    assert [len(s) for s in shingles.shingle_sets(texts)] == [n for _, n, _ in brute_components(list(enumerate(texts)))]


# WARC


def test_warc_round_trip(spark):
    html = [None, "", "<p>same</p>", "<p>same</p>", "x" * 200_000, base64.b64encode(random.Random(1).randbytes(90_000)).decode(), "é🙂", "<p>same</p>"]
    pages = spark.createDataFrame([(k, f"http://a/{k}", h) for k, h in enumerate(html)], "page_id long, url string, html string").withColumn("digest", F.lit(1))
    listed = warc.write_archives(pages, archive_bytes=60_000)
    for size in (700, 1 << 20):
        got = {r.page_id: r for r in warc.read_archives(listed, range_bytes=size, html=True).collect()}
        assert sorted(got) == list(range(len(html)))
        for k, h in enumerate(html):
            data = (h or "").encode()
            assert (got[k].payload_bytes, got[k].payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
            assert got[k].html == (data.decode() if got[k].record_type == "response" else None)
        assert {k: r.refers_to for k, r in got.items() if r.record_type == "revisit"} == {0: 1, 2: 7, 3: 7}
    assert warc.op9_warc(pages.limit(0)).count() == 0
    assert warc.op9_warc(spark.createDataFrame([(None, None, None), (3, None, "a"), (3, None, "a")], pages.drop("digest").schema)).count() == 3


def test_magic_inside_a_record_starts_nothing():
    inner = warc.record(9, "u", b"inner " * 50)
    data = warc.record(1, "u", inner + b"\x1f\x8b\x08" * 40) + warc.record(2, "u", b"b")
    for step in (1, 7, 100, 10_000):
        got = [int(warc.parsed(c)[0]["x-page-id"]) for lo in range(0, len(data), step) for c in warc.read_range(io.BytesIO(data), len(data), lo, min(len(data), lo + step))]
        assert got == [1, 2]


# nearest neighbours


def test_neighbours_against_brute_force(spark):
    g = np.random.default_rng(3)
    x = g.standard_normal((600, 16)).astype(np.float32) * g.uniform(0.3, 3, (600, 1)).astype(np.float32)
    x[100:250] = x[100]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1020, [float("nan")] * 16), (1040, [None] * 16), (None, [1.0] * 16), (1060, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("block", F.lit(1))
    found = 0
    for got in (ann.op10_ann(df), ann.op10_ann(df, block_rows=150, query_rows=10)):
        by = {}
        for r in got.orderBy("query_id", "rank").collect():
            by.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert sorted(by) == list(range(0, 600, 20))
        for q, mine in by.items():
            s = x.astype(float) @ x[q].astype(float)
            want = [k for k in np.lexsort((np.arange(600), -s.round(9))) if k != q][:20]
            found += len(set(want) & {v for v, _ in mine})
            assert all(abs(score - s[v]) < 1e-9 for v, score in mine)
    assert found >= 0.95 * 2 * 30 * 20
    assert ann.op10_ann(df.limit(0)).count() == 0


def test_the_stopping_test_spares_most_vectors_of_clusters():
    r = np.random.default_rng(12)
    centres = r.standard_normal((500, 64))
    x = (centres[r.integers(0, 500, 100_000)] + 0.25 * r.standard_normal((100_000, 64))).astype(np.float32).astype(float)
    hits = verified = 0
    blocks = [ann.Block(np.arange(k, 100_000, 4), x[k::4], 20, float((x**2).sum(1).max())) for k in range(4)]
    for q in range(0, 40_000, 1000):
        found = sorted((t for b in blocks for t in b.nearest(q, x[q])), key=lambda t: (-t[0], t[1]))[:20]
        s = x @ x[q]
        s[q] = -np.inf
        hits += len({v for _, v in found} & set(np.argsort(-s)[:20].tolist()))
    verified = sum(b.verified for b in blocks)
    assert hits >= 0.9 * 40 * 20 and verified < 0.3 * 40 * 100_000


def test_neighbours_over_cells_and_repeated_vectors(spark):
    r = np.random.default_rng(3)
    x = np.concatenate([(c + 0.1 * r.standard_normal((80, 12))) for c in 3 * r.standard_normal((15, 12))]).astype(np.float32)
    x[300:700] = x[300]  # a third of all rows hold one vector
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(k, [float(k), 1.0, 0.5]) for k in range(2000, 2045)] + [(0, [9.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = wanted = 0
    by: dict[int, list] = {}
    for g in ann.op10_ann(df, block_rows=100, query_rows=16).orderBy("query_id", "rank").collect():
        by.setdefault(g.query_id, []).append((g.vec_id, g.score))
    assert sorted(by) == [*range(0, 1200, 20), 2000, 2020, 2040] and all(len(m) == 20 for m in by.values())
    for q in range(20, 1200, 20):
        s = x.astype(float) @ x[q].astype(float)
        want = sorted(np.sort(np.delete(s, q))[::-1][:20].round(6).tolist())
        wanted += 20
        found += sum(min(a, b) >= 0 and abs(a - b) < 1e-5 for a, b in zip(want, sorted(v for _, v in by[q]), strict=True)) if min(want) >= 0 else 20
    assert found >= 0.9 * wanted
    assert [v for v, _ in by[2000]] == list(range(2044, 2024, -1))


def test_chi_square():
    assert np.allclose(ann.chi_square_cdf(np.array([0.0, 7.344, 15.507]), 8), [0, 0.5, 0.95], atol=1e-3)


# the pipeline and the registration


def test_pipeline_and_names(spark):
    import __spark_entry__
    import corpus_pipeline

    names = list(__spark_entry__.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "decontamination", "byte_bpe"]
    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf)
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert 0.6 * n < out.count() < n and out.select("doc_id").distinct().count() == out.count()


def test_warc_of_text_ids_and_foreign_members(spark, tmp_path):
    import gzip

    pages = spark.createDataFrame([("a-1", "u", "same"), ("a-2", "u", "same"), ("b", "u", None), (None, "u", "x")], "page_id string, url string, html string")
    got = {r.page_id: r for r in warc.op9_warc(pages).collect()}
    assert set(got) == {"a-1", "a-2", "b", None} and got["a-1"].refers_to == "a-2" and got["a-2"].record_type == "response"
    data = gzip.compress(b"WA") + gzip.compress(b"WARC/1.1\r\nno length\r\n\r\n") + warc.record(7, "u", b"body", None) + gzip.compress(b"")
    assert [warc.parsed(c)[1] for c in warc.read_range(io.BytesIO(data), len(data), 0, len(data))] == [b"body"]


def test_pipeline_stages_on_odd_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
    items = spark.createDataFrame([(1, "one"), (2, None)], "item_id long, text string").withColumn("doc_id", F.lit(3))
    docs = odd(spark).union(odd(spark).limit(3))
    for rows, name in ((docs, "odd"), (docs.limit(0), "none")):
        sf = f"{tmp_path}/{name}"
        for df, table in ((rows, "documents"), (labels, "labels"), (items, "benchmark")):
            df.write.parquet(f"{sf}/{table}.parquet")
        out = corpus_pipeline.run(spark, sf).collect()
        assert (len(out) > 5) == (name == "odd")
        again = spark.read.parquet(f"{sf}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, again, sf).columns == ["doc_id", "text", "lang", "source", "n_chars"]
