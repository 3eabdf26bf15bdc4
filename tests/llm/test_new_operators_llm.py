"""Token alignment, vector codes and substring removal against brute force, on awkward rows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabgrove.llm import alignment, repeats, vector_codes
from tabgrove.llm.queries import op11_token_alignment, op12_vector_codes
from tabgrove.sources.shared import materialise, shared_folder

FILES = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


@pytest.fixture(scope="module")
def rows():
    """Copies, shared passages, a NULL and a repeated key, NULL, empty, blank, short and
    long texts, a repeated row, special tokens, text that a tokenizer does not spell."""
    draw = random.Random(11)
    say = lambda n: " ".join(draw.choice("alpha beta gamma delta epsilon zeta".split()) + str(draw.randint(0, 60)) for _ in range(n))
    base, passage, line = say(120), say(70), say(50)
    texts = [base, base, "x " + base + " y", say(49), line, "a\n" + line + "\tb", None, "", " \n ", "one two"]
    texts += [say(30) + " " + passage + " " + say(40) for _ in range(5)] + [passage + " " + passage]
    texts += [say(9000) + " " + passage + " " + say(3000), "<|endoftext|> </s> <0x41> é漢🙂 ﬁ", "the " * 400, "z" * 3000]
    table = [(i, t) for i, t in enumerate(texts)]
    return [*table, table[2], (3, base), (None, passage), (None, base)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    table = spark.createDataFrame(rows, "doc_id long, text string")
    extra = {n: F.lit("x") for n in ("key", "mark", "slice", "bucket", "groups", "label", "words")}
    return table.withColumns(extra).repartition(4, "doc_id")


def removed(rows, width):
    last = 2**63
    table = [(last if k is None else k, (t or "").encode().split()) for k, t in rows]
    first = {}
    for k, words in table:
        for i in range(len(words) - width + 1):
            window = tuple(words[i : i + width])
            first[window] = min(first.get(window, last), k)
    out = []
    for k, words in table:
        gone = [False] * len(words)
        for i in range(len(words) - width + 1):
            if first[tuple(words[i : i + width])] < k:
                gone[i : i + width] = [True] * width
        kept = b" ".join(w for w, g in zip(words, gone) if not g).decode()
        out.append((None if k == last else k, len(words), sum(gone), kept))
    return out


def order(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize(("width", "size"), [(50, 4 << 20), (50, 3000), (5, 1000)])
def test_repeats_equal_brute_force(docs, rows, width, size, monkeypatch):
    monkeypatch.setattr(repeats, "SLICE", size)
    out = repeats.remove_repeats(docs, "doc_id", "text", width).collect()
    for row in out:
        ends = [x for s in row["spans"] for x in (s["begin"], s["end"])]
        assert ends == sorted(set(ends))  # maximal: neither overlapping nor touching
    found = [(r["key"], r["n_words"], sum(s["end"] - s["begin"] for s in r["spans"]), r["kept"]) for r in out]
    assert order(found) == order(removed(rows, width))


def test_window_hashes_are_those_of_whole_numbers():
    draw = np.random.default_rng(3)
    words = draw.integers(0, 2**61 - 1, 300).astype(np.uint64)
    prime, base = 2**61 - 1, repeats.BASES[0]
    found = repeats._window_hashes(words, np.arange(251), 50, base)
    for i in (0, 7, 250):
        assert int(found[i]) == sum(int(w) * pow(base, j, prime) for j, w in enumerate(words[i : i + 50])) % prime


def test_swapped_words_of_a_regular_pattern_stay_apart(spark):
    pattern = "a"
    while len(pattern) < 4096:
        pattern += pattern.translate(str.maketrans("ab", "ba"))
    one, two = " ".join(pattern), " ".join(pattern.translate(str.maketrans("ab", "ba")))
    table = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    out = repeats.remove_repeats(table, "doc_id", "text", 4096)
    assert [len(r["spans"]) for r in out.collect()] == [0, 0]


def aligned(texts):
    """Groups and links per text, token by token."""
    a, b = Tokenizer.from_file(FILES[0]), sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    a.encode_special_tokens = True
    letters = {c: i for i, c in enumerate(alignment._byte_letters())}
    out, links = [], []
    for text in texts:
        whole = (" " + (text or "")).encode()
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        pieces = [b.id_to_piece(i) for i in ids_b]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, pieces)]
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            out.append((0, 0, 0, ""))
            links.append([])
            continue
        ends_a = np.cumsum([len(x) for x in bytes_a]).tolist()
        ends_b = np.cumsum([len(x) for x in bytes_b]).tolist()
        links.append([(i, j) for i, e in zip(ids_a, ends_a) for j, f in zip(ids_b, ends_b) if e == f])
        cuts, told, low = sorted({*ends_a} & {*ends_b}), [], 0
        for cut in cuts:
            sides = [[str(i) for i, e in zip(ids, ends) if low < e <= cut] for ids, ends in ((ids_a, ends_a), (ids_b, ends_b))]
            told.append(",".join(sides[0]) + "|" + ",".join(sides[1]))
            low = cut
        out.append((len(ids_a), len(ids_b), len(cuts), ";".join(told)))
    counts = Counter(x for some in links for x in some)
    best = defaultdict(int)
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    return [
        (*o, len(some), sum(counts[x] == best[x[1]] for x in some), sum(counts[x] for x in some))
        for o, some in zip(out, links)
    ]


@pytest.mark.parametrize("size", [2 << 20, 2000])
def test_alignment_equals_brute_force(docs, rows, size, monkeypatch):
    some = [(k, t) for k, t in rows if len(t or "") < 20_000]  # the brute force is quadratic
    table = docs.where("text IS NULL OR length(text) < 20000")
    monkeypatch.setattr(alignment, "SLICE", size)
    files = alignment.Tokenizers(*FILES)
    made = materialise(alignment.align_texts(table, "doc_id", "text", files))
    out = alignment.count_links(made, alignment.pair_totals(made, alignment.vocabulary_size(files)))
    names = ("key", "n_a", "n_b", "n_groups", "groups", "n_links", "n_best", "count_sum")
    found = [tuple(r[n] for n in names) for r in out.collect()]
    assert order(found) == order((k, *x) for (k, _), x in zip(some, aligned([t for _, t in some])))


ODD = [
    " a", "a ", "  a  b ", "\u3000x y", "a\u00a0b c", "a\u200b b", "x\ufeff y", "a\x1c b", "\u2581 a b", "a\u2581 b\u2581 c",
    "it 's we 'll", "1 2 3 \u0661 \u0662", "\n a\n b", "tab\t c d", "e\u0301 \u0301x", "a\x85 b", "a\u180e b c", "\x00 a b", "<s> a </s> b",
]


@pytest.mark.parametrize("call", [1, 1 << 13])
def test_chunks_give_the_tokens_of_whole_texts(call, monkeypatch):
    monkeypatch.setattr(alignment, "CALL", call)
    made = alignment._aligned_slice(0, list(range(len(ODD))), ODD, alignment.Tokenizers(*FILES))
    found = [tuple(made[n][i] for n in ("n_a", "n_b", "n_groups", "groups")) for i in range(len(ODD))]
    assert found == [x[:4] for x in aligned(ODD)]


def test_no_piece_holds_a_space_behind_other_text():
    b = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    pieces = (b.id_to_piece(i) for i in range(b.get_piece_size()))
    assert not [p for p in pieces if "\u2581" in p.lstrip("\u2581")]


def test_coalescing_takes_nested_and_crossing_intervals():
    start, end = np.array([0, 3, 3, 8, 9]), np.array([3, 9, 8, 9, 12])
    order_, group = alignment.coalesced(start, end, np.array([0, 0, 1, 1, 0]))
    assert order_.tolist() == [0, 1, 2, 3, 4] and group.tolist() == [0, 1, 1, 1, 2]


def codes(rows, parts, entries, rounds):
    """Plain lists and whole numbers."""
    kept = sorted(
        ((2**70 if k is None else k, [int(np.floor(1024 * float(x))) for x in v], label) for k, v, label in rows if usable(v)),
        key=lambda r: r[:2],
    )
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for _, v, _ in kept] for p in range(parts)]
    books = [[list(v) for v in c[:entries]] for c in cut]

    def nearest(v, book):
        d = [sum((x - y) ** 2 for x, y in zip(v, e)) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            near = [nearest(v, books[p])[0] for v in cut[p]]
            for e in set(near):
                own = [v for v, n in zip(cut[p], near) if n == e]
                books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    out = []
    for i, (k, _, label) in enumerate(kept):
        each = [nearest(cut[p][i], books[p]) for p in range(parts)]
        out.append((None if k == 2**70 else k, label, [e for e, _ in each], sum(d for _, d in each)))
    return out, books


def usable(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v)


@pytest.fixture(scope="module")
def vector_rows():
    draw = np.random.default_rng(7)
    rows = [(i, draw.normal(size=8).astype(np.float32).tolist(), i % 3 if i % 5 else None) for i in range(200)]
    hot = [(1000 + i, [0.5] * 8, 1) for i in range(80)]
    bad = [(2000, None, 1), (2001, [1.0, None] * 4, 1), (2002, [float("nan")] * 8, 2), (2003, [float("inf")] * 8, 2), (2004, [], 0)]
    return [*rows, *hot, *bad, (None, [0.25] * 8, 0), (3, [0.125] * 8, None), rows[4]]


@pytest.mark.parametrize("entries", [16, 256, 1000])
def test_codes_equal_plain_whole_numbers(spark, vector_rows, entries, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK", 8)
    table = spark.createDataFrame(vector_rows, "vec_id long, embedding array<float>, label int")
    table = table.withColumns({n: F.lit("x") for n in ("row", "part", "key", "v", "codes")}).repartition(3)
    coded, books = vector_codes.compress(table, "vec_id", "embedding", "label", 4, entries, 4)
    expected, books_expected = codes(vector_rows, 4, entries, 4)
    assert [b.tolist() for b in books] == books_expected
    assert order(tuple(r) for r in coded.collect()) == order(expected)
    sums = defaultdict(int)
    for _, label, _, error in expected:
        sums[label] += error
    found = {r["label"]: r["label_error"] for r in vector_codes.label_errors(coded).collect()}
    assert found == dict(sums)


def test_shortlists_lose_no_nearest_entry():
    draw = np.random.default_rng(5)
    for _ in range(50):
        book = draw.integers(-50, 50, (30, 3))
        flat = draw.integers(-50, 50, 3) + draw.integers(-4, 5, (20, 3))
        some = vector_codes._shortlist(flat.min(axis=0), flat.max(axis=0), book)
        near, distance = vector_codes._nearest(flat, book)
        again, same = vector_codes._nearest(flat, book[some])
        assert (some[again] == near).all() and (distance == same).all()


def test_the_curve_visits_neighbours_in_turn():
    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    place = [p.tobytes() for p in vector_codes._hilbert(cells, 3)]
    path = cells[np.argsort(place)]
    assert len(set(place)) == 512 and (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_large_components_raise(spark):
    table = spark.createDataFrame([(1, [1e9] * 4, 0)], "vec_id long, embedding array<float>, label int")
    with pytest.raises(Exception, match="component"):
        vector_codes.compress(table, "vec_id", "embedding", "label")
    table = spark.createDataFrame([(1, [1.0] * 6, 0)], "vec_id long, embedding array<float>, label int")
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress(table, "vec_id", "embedding", "label")


def test_empty_tables_give_no_rows(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.remove_repeats(docs, "doc_id", "text").count() == 0
    folder = shared_folder(spark)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    assert op11_token_alignment(spark, folder).count() == 0
    out = op12_vector_codes(spark, folder)
    assert out.count() == 0 and out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_digest_of_codebooks():
    books = [np.array([[1, -2]]), np.array([[3, 4]])]
    assert vector_codes.codebooks_digest(books) == hashlib.sha256(b"1,-2,3,4").hexdigest()
