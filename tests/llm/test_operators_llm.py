import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import cases
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from flowspark.llm import (components, exact, exchange, golomb, lines, minhash, mixing, packing, pii, quality, repeats, tokens,
                           toxicity)
from flowspark.llm.common import slices
from flowspark.llm.encoders import encoder
from flowspark.llm.minhash import WordHashes

BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return cases.frame(spark).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return cases.frame(spark, [])


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


# Token counts ---------------------------------------------------------------------------------------

def test_counts_are_the_librarys(docs, library):
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(docs, BPE, chunk=2000).collect())
    want = Counter()
    for i, text in cases.texts():
        n = len(ids_of(library, text))
        want[(i, len((text or "").encode()), n, n > 1024)] += 1
    assert got == want


def test_spliced_chunks_equal_the_whole(library):
    enc, rng = encoder(BPE), random.Random(5)
    parts = ["foo", "bar ", " ", "\n", "'s", "'re", "<|endoftext|>", "  ", "é", "\xa0", "12", "?!", "don't", "xyz" * 40, "日本"]
    for _ in range(150):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 400)))
        got = np.concatenate([run for run, _ in tokens.spliced(text, enc, 64, 16)]).tolist()
        assert got == ids_of(library, text) == enc.ids(text).tolist()


def test_overlaps_widen_where_no_boundary_is_near():
    enc = encoder(BPE)
    text = "ab cd " * 20 + "x" * 300 + " ef gh" * 40
    assert sum(w for _, w in tokens.spliced(text, enc, 200, 16)) > 0


# Exact and near duplicates -------------------------------------------------------------------------

def test_golomb_round_trip():
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 3000):
        keys = np.unique(rng.integers(1 << 20, 1 << 48, n, dtype=np.uint64))
        k, code = golomb.encode(keys, 1 << 20)
        assert (golomb.decode(code, len(keys), k, 1 << 20) == keys).all()
        flags = rng.random(n) < 0.3
        assert (golomb.unpack(golomb.pack(flags), n) == flags).all()


def test_exact_copies(docs):
    groups, least = defaultdict(list), {}
    rows = [(i, cases.normal(t)) for i, t in cases.texts()]
    for i, text in rows:
        groups[text].append(i)
    for text, ids in groups.items():
        least[text] = min((i for i in ids if i is not None), default=None)
    want = Counter((i, least[t], len(groups[t]), None if i is None else i == least[t], cases.sha(t)) for i, t in rows)
    got = Counter(tuple(r) for r in exact.exact_duplicates(docs, block_rows=4).collect())
    assert got == want


def test_exact_copies_without_ids(spark):
    rows = [(None, "alone"), (None, "a  pair"), (None, "a pair"), (3, "with\none"), (None, "with one"), (0, "zero"), (None, None), (0, "zero")]
    got = Counter(tuple(r)[:4] for r in exact.exact_duplicates(cases.frame(spark, rows).repartition(3), block_rows=2).collect())
    assert got == Counter([(None, None, 1, None)] * 2 + [(None, None, 2, None)] * 2 + [
        (3, 3, 2, True), (None, 3, 2, None), (0, 0, 2, True), (0, 0, 2, True)])


def test_exact_copies_of_hot_groups(spark, monkeypatch):
    from flowspark.llm import common

    monkeypatch.setattr(common, "HOT_SHARE", 4)
    rows = [(i, "the same" if i % 2 else f"pair {i // 4}") for i in range(60)]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact.exact_duplicates(cases.frame(spark, rows)).collect()}
    assert all(got[i] == ((1, 30) if i % 2 else (i - i % 4, 2)) for i in range(60))


def brute_classes(rows):
    sets, parent = {}, {}
    for i, text in rows:
        if i is not None:
            w = cases.words(text)
            sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
            parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b:
                union = len(sets[a] | sets[b])
                if (union == 0) or len(sets[a] & sets[b]) >= 0.8 * union:
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_near_copies(docs):
    want = brute_classes(cases.texts())
    got = minhash.near_duplicates(docs).collect()
    assert {r.doc_id: r.class_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)


def test_texts_that_share_an_id_are_judged_on_their_own(spark):
    x, near = cases.prose(70, 120), cases.prose(70, 120).rsplit(" ", 1)[0] + " other"
    rows = [(1, x), (2, x), (2, cases.prose(71, 90)), (3, cases.prose(72, 80)), (3, cases.prose(73, 80)), (3, near), (4, x), (4, x), (0, None)]
    frame = cases.frame(spark, rows).repartition(4)
    got = Counter(tuple(r) for r in minhash.near_duplicates(frame).collect())
    assert got == Counter([(1, 1, True), (2, 1, False), (2, 2, True), (3, 3, True), (3, 3, True), (3, 1, False), (4, 1, False), (4, 1, False),
                           (0, 0, True)])
    kept = Counter((r.doc_id, r.text) for r in minhash.one_of_each(frame).collect())
    assert kept == Counter(rows[i] for i in (0, 2, 3, 4, 8))


def test_near_copies_of_a_template_are_one_class(spark):
    base, rng, rows = cases.prose(50, 200).split(), random.Random(2), []
    for i in range(40):
        copy = list(base)
        for place in rng.sample(range(200), 3 if i else 0):
            copy[place] = f"edit{i}"
        rows.append((100 - i, " ".join(copy)))
    want = brute_classes(rows)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(cases.frame(spark, rows)).collect()}
    assert got == want and len(set(want.values())) < 40


def test_near_copies_with_a_line_repeated_many_times(spark):
    rows = []
    for i in range(12):
        page = cases.prose(600 + i, 300)
        line = " ".join(page.split()[-20:])
        rows += [(2 * i, page), (2 * i + 1, page + f"\n{line}" * (50 + 15 * i))]
    want = brute_classes(rows)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(cases.frame(spark, rows)).collect()}
    assert got == want and len(set(want.values())) == 12


def test_registers_agree_with_probability_jaccard():
    rng = np.random.default_rng(3)
    elements = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    a, b = rng.integers(1, 4, 300).astype(float), rng.integers(0, 4, 300).astype(float)
    other = b > 0
    x, y = a / a.sum(), b / b.sum()
    exact_value = sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in range(300)) for i in range(300) if y[i] > 0)
    found = minhash.signatures(np.concatenate([elements, elements[other]]), np.concatenate([a, b[other]]),
                               np.repeat([0, 1], [300, other.sum()]), 2, 4096)
    assert abs((found[0] == found[1]).mean() - exact_value) < 0.04


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 230)] + [(3, 7)]
    found = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.id: r.component for r in found} == {i: 100 for i in range(100, 141)} | {
        i: 3 for i in (3, 7, *range(200, 230))}


# Lines and passages ------------------------------------------------------------------------------------

def brute_lines(rows):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\v\f\r"))
    holders = defaultdict(set)
    for i, text in rows:
        if i is not None:
            for line in (text or "").split("\n"):
                holders[key(line)].add(i)
    out = Counter()
    for i, text in rows:
        parts = (text or "").split("\n")
        kept = [p for p in parts if i is None or len(key(p)) < 20 or len(holders[key(p)]) < 3 or max(holders[key(p)]) == i]
        out[(i, len(parts), len(parts) - len(kept), cases.sha("\n".join(kept)))] += 1
    return out


def test_repeated_lines(docs):
    assert Counter(tuple(r) for r in lines.line_report(docs).collect()) == brute_lines(cases.texts())


def test_hot_lines_are_split_and_added_up(spark):
    rows = [(i, f"the line that every one of them has\nand a line of its own, number {i:06d}") for i in range(500)]
    got = Counter(tuple(r) for r in lines.line_report(cases.frame(spark, rows).repartition(7)).collect())
    assert got == brute_lines(rows)


def test_dropping_lines_keeps_columns(docs):
    out = lines.drop_repeated_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()


def test_no_python_in_line_dedup(docs):
    plan = lines.line_report(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def brute_repeats(rows):
    first = {}
    for i, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = cases.words(text)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k:k + 13]), i)
    out = Counter()
    for i, text in rows:
        w = cases.words(text)
        gone = set()
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k:k + 13])] < i:
                gone.update(range(k, k + 13))
        out[(i, len(w), len(gone), cases.sha(" ".join(x for k, x in enumerate(w) if k not in gone)))] += 1
    return out


def test_repeated_passages(docs):
    got = repeats.repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert Counter(tuple(r) for r in got) == brute_repeats(cases.texts())


def test_every_shared_window_has_a_shared_anchor():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
    b = np.concatenate([rng.integers(0, 1 << 63, 37, dtype=np.uint64), a[40:53], rng.integers(0, 1 << 63, 9, dtype=np.uint64)])
    assert repeats.anchors(a)[0][40] == repeats.anchors(b)[0][37]


# Quality, personal data, toxicity --------------------------------------------------------------------

def brute_quality(text):
    w = cases.words(text)
    n = len(w)
    seen = Counter(tuple(w[k:k + 8]) for k in range(n - 7))
    again = {j for k in range(n - 7) if seen[tuple(w[k:k + 8])] > 1 for j in range(k, k + 8)}
    parts = (text or "").split("\n")
    dup = sum(1 for k, p in enumerate(parts) if cases.words(p) and p in parts[:k])
    failed = n < 20 or 100 * len(again) > 30 * n
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(again), failed


def test_quality_counts(docs):
    got = Counter((r.doc_id, *r[1:7]) for r in quality.quality_report(docs).collect())
    assert got == Counter((i, *brute_quality(t)) for i, t in cases.texts())


def test_bands_keep_prose_and_reject_noise_and_repeats(spark):
    rng = random.Random(6)
    noise = " ".join("".join(chr(rng.randrange(0x21, 0x2FFF)) for _ in range(12)) for _ in range(400))
    rows = [(1, cases.prose(9, 400)), (2, noise), (3, " ".join(f"{w} {w} {w} {w}" for w in cases.prose(10, 300).split()))]
    got = {r.doc_id: r.reason for r in quality.quality_report(cases.frame(spark, rows)).collect()}
    assert got[1] == "" and got[2] in ("incompressible", "chunks") and got[3] in ("repetitive", "chunks")
    assert {r.doc_id for r in quality.passing(cases.frame(spark, rows)).collect()} == {1}


def test_base_spans():
    text = "mail A.b+c@ex-am.ple.org, 1.2.3.4 or 1.2.3.400; 4111 1111-1111 1111 and +1 (705) 555-0199."
    assert [(k, text[s:e]) for s, e, k in pii.base_spans(text)] == [
        ("email", "A.b+c@ex-am.ple.org"), ("ip", "1.2.3.4"), ("card", "4111 1111-1111 1111"),
        ("phone", "+1 (705) 555-0199")]


def test_terms_that_go_with_an_entity_only_are_added(spark):
    rows = [(i, cases.prose(200 + i, 30)) for i in range(60)]
    rows += [(100 + i, f"{cases.prose(300 + i, 5)} Quimby answers at quimby@example.org {cases.prose(400 + i, 5)}") for i in range(4)]
    out = {r.doc_id: r for r in pii.span_report(cases.frame(spark, rows)).collect()}
    assert all(out[i].spans == "" for i in range(60))
    for i in range(4):
        text = rows[60 + i][1]
        at = text.index("Quimby")
        assert f"term_removed:{at}:{at + 6}" in out[100 + i].spans and out[100 + i].n_email == 1
        s = text.index("quimby@")
        assert out[100 + i].base_sha256 == cases.sha(f"email:{s}:{s + 18}")
    frame = cases.frame(spark, rows)
    clean = {r.doc_id: r.text for r in pii.sanitised(frame, pii.personal_data(frame)).collect()}
    assert "Quimby" not in clean[100] and "<email>" in clean[100] and clean[0] == rows[0][1]


def test_every_place_of_a_disclosing_term_is_marked(spark):
    rows = [(i, cases.prose(200 + i, 30)) for i in range(60)]
    rows += [(100 + i, f"Quimby writes. {cases.prose(300 + i, 40)} Quimby, quimby@example.org {cases.prose(400 + i, 40)} quimby") for i in range(4)]
    # Near the address in two documents, far from it in two.
    rows += [(200 + i, f"{cases.prose(500 + i, 3)} Wendell wendell@example.org {cases.prose(600 + i, 30)}") for i in range(2)]
    rows += [(210 + i, f"Wendell {cases.prose(700 + i, 40)} wendell@example.org") for i in range(2)]
    frame = cases.frame(spark, rows)
    out = {r.doc_id: r.spans for r in pii.personal_data(frame).collect()}
    for i, text in rows[60:]:
        name = "quimby" if i < 200 else "wendell"
        want = [m.span() for m in re.finditer(rf"(?i)\b{name}\b(?!@)", text)]
        assert [(s.start, s.end) for s in out[i] if s.kind == "term_removed" and text[s.start:s.end].lower() == name] == want
    clean = {r.doc_id: r.text for r in pii.sanitised(frame, pii.personal_data(frame)).collect()}
    assert not any(re.search("(?i)quimby|wendell", clean[i]) for i, _ in rows[60:])


def test_spans_of_awkward_texts(docs):
    out = pii.span_report(docs)
    assert out.count() == docs.count() and out.where("spans != ''").count() == 0


def test_toxicity_on_held_out_documents(spark):
    rng, rows, labels = random.Random(7), [], []
    for i in range(900):
        sentences = [cases.prose(1000 + 50 * i + k, 8).capitalize() + "." for k in range(10)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(2):
                k = rng.randrange(10)
                sentences[k] = sentences[k].replace(" ", f" {rng.choice(['vile', 'hateful', 'wretch'])} ", 1)
        rows.append((i, " ".join(sentences)))
        labels.append((i, int(toxic)))
    table = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.toxicity(cases.frame(spark, [*rows, (5000, None)]), table).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(out[i].held_out for i in held) and sum(r.held_out for r in out.values()) - len(held) in (0, 1)
    assert sum(out[i].predicted == (i % 5 == 0) for i in held) >= 0.97 * len(held)
    assert out[5000].score == 0 and out[5000].predicted == 0
    for i in held:
        if i % 5 == 0 and out[i].sentences:
            s = out[i].sentences[0]
            assert re.search("vile|hateful|wretch", rows[i][1][s.start:s.end], re.I)


# Mixture and packing -----------------------------------------------------------------------------------

def test_shortages_go_to_siblings_first():
    supply = {("a", "x", "1"): 10, ("a", "x", "2"): 90, ("b", "x", "1"): 100}
    weights = {("a", "x", "1"): 1.0, ("a", "x", "2"): 1.0}
    assert mixing.budgets(supply, weights, 100, 1) == {("a", "x", "1"): 10, ("a", "x", "2"): 40, ("b", "x", "1"): 50}
    assert mixing.budgets(supply, weights, 190, 1)[("b", "x", "1")] == 95
    assert sum(mixing.budgets(supply, weights, 10_000, 2).values()) == 400


def test_mixture_takes_prefixes_of_epochs(spark, docs):
    from pyspark.sql import functions as F

    weights = {("d", "", "src0"): 5.0}
    got = mixing.mixture(docs.where("doc_id is not null and doc_id <> 18"), F.lit("d"), weights, epochs=3).collect()
    rows = [(i, t) for i, t in cases.texts() if i not in (None, 18) and cases.words(t)]
    leaf = {i: ("d", "en" if i % 3 else "", f"src{i % 12}") for i, _ in rows}
    size = {i: len(cases.words(t)) for i, t in rows}
    supply = Counter()
    for i in size:
        supply[leaf[i]] += size[i]
    want = set()
    for node, budget in mixing.budgets(supply, weights, sum(supply.values()), 3).items():
        full, rest = divmod(budget, supply[node])
        here = [i for i in size if leaf[i] == node]
        want |= {(i, e, size[i]) for e in range(full) for i in here}
        for i in sorted(here, key=lambda i: hashlib.md5(f"0:{full}:{i}".encode()).hexdigest()):
            if rest > 0:
                want.add((i, full, min(rest, size[i])))
            rest -= size[i]
    assert {(r.doc_id, r.epoch, r.n_taken) for r in got} == want and len(got) == len(want)
    out = mixing.mixed(docs, F.lit("d"), weights, epochs=3)
    assert out.columns == docs.columns and out.count() > 0


def test_packing_places_every_id_once(docs, library):
    pieces = packing.pack(docs.where("doc_id is not null and doc_id <> 18"), BPE, shard_docs=8).collect()
    want = {i: np.array([*ids_of(library, t), 0], "<u4") for i, t in cases.texts() if i not in (None, 18)}
    by, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = want[p.doc_id][p.start:p.start + p.length]
        assert zlib.crc32(ids.tobytes()) == p.ids_crc32 and p.doc_tokens == len(want[p.doc_id])
        by[p.doc_id].append((p.start, p.length))
        sequences[p.sequence_id].append((p.offset, p.length))
    for where, total in [*((by[i], len(want[i])) for i in want), *((s, None) for s in sequences.values())]:
        at = 0
        for a, n in sorted(where):
            assert a == at and n > 0
            at += n
        assert at == total if total is not None else at <= 1024


def test_neighbours_share_terms():
    rng = np.random.default_rng(8)
    topic = [rng.integers(1000 * t, 1000 * t + 60, 300).astype("<u4") for t in (1, 2) for _ in range(6)]
    mixed = [topic[i] for i in (0, 6, 1, 7, 2, 8, 3, 9, 4, 10, 5, 11)]
    by = defaultdict(list)
    for sequence, doc, *_ in packing.fill(mixed, 900):
        by[sequence].append(doc % 2)
    assert sum(len(set(s)) == 1 for s in by.values()) >= 3


def brute_bm25(tokens, seed):
    counts, out = [Counter(t.tolist()) for t in tokens], []
    mean = sum(map(len, tokens)) / len(tokens)
    df = Counter(term for c in counts for term in c)
    for c, t in zip(counts, tokens):
        out.append(sum(np.log1p((len(tokens) - df[x] + 0.5) / (df[x] + 0.5)) * c[x] * 2.2 / (
            c[x] + 1.2 * (0.25 + 0.75 * len(t) / mean)) for x in counts[seed] if x in c))
    return np.array(out)


def test_scores_are_bm25_of_all_terms_of_the_seed():
    # Each seed shares 30 rare terms with a decoy, and 200 commoner ones with its topic.
    rng = np.random.default_rng(9)
    tokens = [np.concatenate([rng.permutation(200)[:180] + 1000 * (i % 3), np.arange(30) + 10_000 + 100 * (i // 2)]).astype("<u4")
              for i in range(30)]
    shard = packing.Shard(tokens)
    followers = defaultdict(list)
    for sequence, doc, *_ in packing.fill(tokens, 800):
        followers[sequence].append(doc)
    want = brute_bm25(tokens, 0)
    want[0] = -1
    assert np.allclose(want[followers[0][1:4]], np.sort(want)[::-1][:3])
    for seed in (0, 7, 29):
        assert np.allclose(np.ravel(shard.scores([seed])), brute_bm25(tokens, seed))


# Empty tables --------------------------------------------------------------------------------------------

def test_empty_tables(spark, empty):
    from pyspark.sql import functions as F

    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for out in (pii.span_report(empty), mixing.mixture(empty, F.lit("d"), {}), lines.line_report(empty),
                quality.quality_report(empty), toxicity.toxicity(empty, labels), packing.pack(empty, BPE),
                repeats.repeats(empty), minhash.near_duplicates(empty), exact.exact_duplicates(empty),
                tokens.count_tokens(empty, BPE), quality.passing(empty), lines.drop_repeated_lines(empty),
                minhash.one_of_each(empty), mixing.mixed(empty, F.lit("d"), {})):
        assert out.count() == 0


def test_owners_of_repeats_are_planned_by_what_texts_hold(spark, monkeypatch):
    # Few long texts: thousands of anchors each, and the copy's every window.
    long = cases.prose(1, 8_000)
    rows = [(1, long), (2, "own words first " + long), (3, cases.prose(2, 8_000)), (None, cases.prose(3, 500))]
    docs, planned = cases.frame(spark, rows), []
    whole = sorted(map(str, repeats.repeats(docs).collect()))
    of = exchange.owners_for
    monkeypatch.setattr(repeats.exchange, "owners_for", lambda spark, keys, *held: planned.append(keys) or of(spark, keys, *held))
    monkeypatch.setattr(repeats, "OWNER_KEYS", 500)
    monkeypatch.setattr(repeats, "BLOCK_KEYS", 700)
    assert sorted(map(str, repeats.repeats(docs).collect())) == whole
    hashes = WordHashes()
    found = [len(np.unique(repeats.anchors(hashes(t.encode().split()))[0])) for i, t in rows if i]
    assert planned[0] >= sum(found) > 400 * len(rows)
    # Windows of both copies, counted.
    assert 2 * (8_000 - 12) <= planned[1] <= 2 * 8_000 + 50


def test_batches_are_taken_in_slices():
    batch = pa.RecordBatch.from_pydict({"x": [bytes(100)] * 90 + [bytes(50_000)]})
    cut = list(slices(iter([batch, batch.slice(0, 0)]), 6_000))
    assert sum(b.num_rows for b in cut) == 91 and max(b.num_rows for b in cut) < 12
    assert [b.num_rows for b in slices(iter([batch]), 1)] == [1] * 91
