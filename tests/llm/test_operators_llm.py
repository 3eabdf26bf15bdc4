"""Training-data operators against brute force, on small tables with awkward rows."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from tabgrove.llm import bpe, chat, importance, jaccard, mixing, secrets, sharding, sketch, token_files, vectors
from tabgrove.llm.common import components, ranked
from tabgrove.llm.queries import RANKS, SEPARATOR, op3_secret_scan, op4_byte_bpe, op7_scaled_sketch, spans_text
from tabgrove.sources.shared import shared_folder

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    """Copies, near copies, ties, NULLs, empty and very long texts, a repeated row, and
    columns whose names the operators use themselves."""
    draw = random.Random(5)
    vocabulary = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(1, 7))) for _ in range(300)]
    say = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    base, common = say(80), say(60)
    texts = [base, base.upper(), base.replace(" ", "\n\t"), base + " tail", "head " + base, None, "", " \n ", "one", "two words"]
    texts += [common + " " + say(120) for _ in range(12)] + [say(k) for k in (1, 4, 5, 6, 400)] + [say(20_000)]
    texts += ["it's we'll  don't\r\n\n x 12½ é漢 🙂", "a" * 5000, "'" * 300 + "s", base]
    rows = [(i, t, "en", ("b", "a", None, "c")[i % 4], len(t or "")) for i, t in enumerate(texts)]
    table = spark.createDataFrame([*rows, rows[3]], DOCUMENTS)
    extra = {n: F.lit("x") for n in ("key", "node", "size", "position", "ids", "target", "own")}
    return table.withColumns(extra).repartition(4, "doc_id")


def rows_of(df, *names):
    return [tuple(row[n] for n in names) for row in df.collect()]


def reachable(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_ranks_are_gapless_within_groups_with_ties_and_nulls(spark):
    data = [(None if k == 0 else k, v % 3) for k in range(3) for v in range(20)] + [(1, None)] * 2
    df = spark.createDataFrame(data, "g int, v int").repartition(3)
    out = rows_of(ranked(df, ["v"], group=["g"]), "g", "v", "position")
    by_group = defaultdict(list)
    for g, v, p in out:
        by_group[g].append((p, (v is not None, v)))
    assert len(out) == len(data)
    for found in by_group.values():
        found.sort()
        assert [p for p, _ in found] == list(range(len(found)))
        assert [v for _, v in found] == sorted(v for _, v in found)


def test_components_are_smallest_reachable_nodes(spark):
    draw = random.Random(2)
    links = [(draw.randint(0, 400), draw.randint(0, 400)) for _ in range(260)] + [(500 + i, 501 + i) for i in range(60)]
    found = dict(rows_of(components(spark.createDataFrame(links, "a long, b long")), "node", "component"))
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert found == reachable(nodes, [(a, b) for a, b in links if a != b])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1 ------------------------------------------------------------------------------------


def test_importance_sample_has_its_size_and_prefers_the_target(spark):
    draw = random.Random(3)
    word = lambda c: "".join(draw.choice(c) for _ in range(4))
    texts = [" ".join(word("abcd" if i % 5 else "%$#!") for _ in range(50)) for i in range(400)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(0, 200)], "doc_id long, quality int")
    out = importance.resample(df, labels, "doc_id", "text", buckets=512)
    kept = {row[0]: row[1] for row in rows_of(out, "doc_id", "kept")}
    assert len(kept) == 402 and sum(kept.values()) == round(0.8 * 402)
    assert all(kept[i] for i in range(400) if i % 5)
    assert sorted(rows_of(out, "rank")) == [(i,) for i in range(402)]
    again = importance.resample(df.repartition(7), labels, "doc_id", "text", buckets=512)
    assert {row[0]: row[1] for row in rows_of(again, "doc_id", "kept")} == kept
    unlabelled = importance.resample(df, labels.limit(0), "doc_id", "text", buckets=512)
    assert all(k for (k,) in rows_of(unlabelled, "kept"))
    assert importance.resample(df.limit(0), labels, "doc_id", "text", buckets=512).count() == 0


def test_features_do_not_depend_on_how_texts_are_batched():
    import pyarrow as pa

    from tabgrove.llm.common import utf8

    texts = ["Ab ab!! %%% é 12", None, "", "x x x", "  "]
    whole = importance.features(*utf8(pa.array(texts)), 1 << 10)
    for i, text in enumerate(texts):
        alone, _ = importance.features(*utf8(pa.array([text], pa.string())), 1 << 10)
        assert sorted(alone) == sorted(whole[0][whole[1] == i])


def plain_mixed(h):
    """A mix of 64 bits, in whole numbers."""
    m = 2**64 - 1
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & m
    h = (h ^ h >> 27) * 0x94D049BB133111EB & m
    return h ^ h >> 31


def plain_hash(token):
    """The first hash of a run of bytes: length, then eight bytes at a time."""
    m = 2**64 - 1
    if len(token) > 64:
        return int.from_bytes(xxhash.xxh3_128_digest(token)[:8], "little")
    h = plain_mixed(int.from_bytes(token[:8], "little") + plain_mixed(len(token) + 0x51) & m)
    for at in range(8, len(token), 8):
        h = plain_mixed(h * 3 + int.from_bytes(token[at : at + 8], "little") & m)
    return h


def plain_grams(text, buckets):
    """Buckets of a text's n-grams, token by token."""
    m, tokens = 2**64 - 1, []
    kinds = rb"[\x09-\x0d\x1c-\x20]+|[0-9A-Za-z\x80-\xff]+|[^\x09-\x0d\x1c-\x200-9A-Za-z\x80-\xff]+"
    for token in plain_tokens((text or "").encode(), kinds):
        fold = bytes(b + 32 if 65 <= b <= 90 else b for b in token)
        tokens.append((token, plain_hash(fold)))
    shapes = []
    for i, (token, word) in enumerate(tokens):
        low = sum(97 <= b <= 122 or b >= 128 for b in token)
        high = sum(65 <= b <= 90 for b in token)
        if token[0] < 128 and not chr(token[0]).isalnum():
            shape = word
        elif low + high == 0:
            shape = 1
        elif high == 0:
            shape = 2
        elif low:
            shape = 3
        else:
            shape = 4 if len(token) > 1 else 3
        again = int(i > 0 and word == tokens[i - 1][1])
        shapes.append(plain_mixed((shape * 2 + again) & m))
    grams = [w for _, w in tokens]
    grams += [plain_mixed((a * 3 + b) & m) for a, b in zip(shapes, shapes[1:])]
    grams += [plain_mixed((plain_mixed((a * 5 + b) & m) + c) & m) for a, b, c in zip(shapes, shapes[1:], shapes[2:])]
    return [g % buckets for g in grams]


def plain_tokens(data, kinds):
    """Words of letters and digits, runs of punctuation; blanks fall away."""
    out = [m[0] for m in re.finditer(kinds, data)]
    return [t for t in out if not re.fullmatch(rb"[\x09-\x0d\x1c-\x20]+", t)]


def test_hashes_of_runs_equal_plain_ones_and_differ():
    from tabgrove.llm.common import run_hashes

    draw = random.Random(17)
    runs = [bytes(draw.choice(b"ab\0") for _ in range(draw.choice([1, 2, 7, 8, 9, 16, 17, 63, 64, 65, 200]))) for _ in range(3000)]
    runs = list(dict.fromkeys(runs)) + [b"a" * n for n in range(201, 300)]
    starts = np.cumsum([0, *map(len, runs)])[:-1]
    found = run_hashes(np.frombuffer(b"".join(runs), np.uint8), starts)
    assert found[0].tolist() == [plain_hash(r) for r in runs]
    assert len(set(found[0].tolist())) == len(set(found[1].tolist())) == len(runs)
    assert run_hashes(np.zeros(0, np.uint8), np.zeros(0, np.int64)).shape == (2, 0)


def test_weights_and_sample_equal_a_plain_reference(spark):
    draw = random.Random(31)
    word = lambda c: "".join(draw.choice(c) for _ in range(draw.randint(1, 5)))
    styles = ["abcdé", "ABcd", "%$# !", "0123", "ab\n\t.", "a1B2"]
    texts = [" ".join(word(styles[draw.randint(0, i % 6)]) for _ in range(draw.randint(0, 40))) for i in range(150)]
    texts += [None, "", " \n", "X", "x" * 20_000, "12 12 12 !! !!"]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [rows[3], (None, texts[7]), (5, "other text 12")]
    labels = [(i, int(i % 3 > 0)) for i in range(0, 120)] + [(None, 1), (5, None), (9999, 1)]
    buckets, seed = 256, 0
    good = {k for k, q in labels if k is not None and q == 1}
    known = [(k, q) for k, q in labels if k is not None and q is not None]
    raw, target = [0.0] * buckets, [0.0] * buckets
    for k, t in rows:
        for g in plain_grams(t, buckets):
            raw[g] += 1
            target[g] += k in good
    total = sum(r + 1.0 for r in raw)
    strength = buckets**0.5
    share = [(r + 1.0) / total for r in raw]
    ratio = [math.log((t + strength * s) / (sum(target) + strength)) - math.log(s) for t, s in zip(target, share)]
    expected = []
    for k, t in rows:
        weight = sum(ratio[g] for g in plain_grams(t, buckets))
        digits = hashlib.md5(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[: importance.DIGITS]
        u = (int(digits, 16) + 0.5) / 16.0**importance.DIGITS
        expected.append((k, weight, weight - math.log(-math.log(u))))
    kept = round(sum(q for _, q in known) / len(known) * len(rows))
    limit = sorted((g for *_, g in expected), reverse=True)[kept - 1]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    df = df.withColumns({n: F.lit("x") for n in ("key", "cost", "rank", "log_weight", "bucket")})
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    out = importance.resample(df, table, "doc_id", "text", buckets=buckets, seed=seed)
    found = sorted(rows_of(out, "doc_id", "log_weight", "kept", "rank"), key=lambda r: r[3])
    assert [r[3] for r in found] == list(range(len(rows)))
    by_rank = sorted(expected, key=lambda e: -e[2])
    for (k, weight, is_kept, _), (key, plain, cost) in zip(found, by_rank):
        assert (k, is_kept) == (key, cost >= limit) and weight == pytest.approx(plain, abs=1e-6)


# --- 2 ------------------------------------------------------------------------------------


def vector_table(spark):
    draw = np.random.default_rng(1)
    base = draw.standard_normal((300, 16))
    near = base[:80] + 0.05 * draw.standard_normal((80, 16))
    crowd = base[0] + 0.02 * draw.standard_normal((60, 16))
    all_ = np.concatenate([base, near, crowd, np.repeat(base[5:6], 40, 0)]).astype(np.float32)
    rows = [(i, v.tolist(), i % 2 if i < 300 else (i - 300) % 2 if i < 380 else 0) for i, v in enumerate(all_)]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [float("nan")] * 16, 0), (n + 3, rows[0][1], None)]
    rows += [(n + 4, [1.0, 2.0], 0), (n + 5, [2.0, 4.0], 0), (n + 6, [None, 1.0], 0), (n + 7, [], 0)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)


def brute_links(rows, threshold):
    usable = [
        (i, np.array(v, np.float64), l)
        for i, v, l in rows
        if l is not None and v and None not in v and np.isfinite(v).all() and np.any(v)
    ]
    links = []
    for x, (i, v, l) in enumerate(usable):
        for j, w, m in usable[x + 1 :]:
            if l == m and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= threshold:
                links.append((i, j))
    return links


@pytest.mark.parametrize("bucket, block", [(512, 2048), (8, 16)])
def test_linked_vectors_match_all_pairs(spark, monkeypatch, bucket, block):
    monkeypatch.setattr(vectors, "BUCKET", bucket)
    monkeypatch.setattr(vectors, "BLOCK", block)
    rows, df = vector_table(spark)
    found = {r[0]: r[1:] for r in rows_of(vectors.link_vectors(df), "vec_id", "n_links", "component_id", "kept")}
    links = brute_links(rows, 0.98)
    part = reachable([r[0] for r in rows], links)
    degree = defaultdict(int)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    assert found == {i: (degree[i], part[i], part[i] == i) for i, _, _ in rows}
    assert vectors.link_vectors(df.limit(0)).count() == 0


def pairs_at(cosine, n, dim, draw):
    """Pairs of unit vectors with a given cosine."""
    a, w = draw.standard_normal((2, n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    w -= (w * a).sum(axis=1, keepdims=True) * a
    return a, cosine * a + np.sqrt(1 - cosine**2) * w / np.linalg.norm(w, axis=1, keepdims=True)


def test_estimates_are_unbiased():
    draw = np.random.default_rng(4)
    units = draw.standard_normal((200, 32))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    exact, errors = units @ units.T, []
    for seed in range(20):
        steps, step, factors, _ = vectors.encode(units, seed)
        errors.append((vectors.estimates(steps, step, steps, factors) - exact)[np.triu_indices(200, 1)].mean())
    assert abs(np.mean(errors)) < 0.005


@pytest.mark.parametrize("dim", [5, 16, 64])
@pytest.mark.parametrize("failure", [0.02, 0.2])
def test_confidence_bounds_fail_as_often_as_stated(dim, failure):
    draw, missed, total = np.random.default_rng(6), 0, 0
    for seed in range(40):
        a, b = pairs_at(0.9, 100, dim, draw)
        one, two = vectors.encode(a, seed), vectors.encode(b, seed)
        about = np.diag(vectors.estimates(one[0], one[1], two[0], two[2]))
        margin = vectors.margins(two[2], dim, 0.9, failure)
        missed, total = missed + int((about < 0.9 - margin).sum()), total + 100
    assert 0.5 * failure < missed / total < 1.5 * failure + 0.005


def test_bounds_at_the_registered_failure_miss_nothing_and_leave_little_open():
    draw = np.random.default_rng(8)
    for seed in range(30):
        a, b = pairs_at(0.98, 500, 64, draw)
        one, two = vectors.encode(a, seed), vectors.encode(b, seed)
        near = vectors.inner_products(one[0], one[1], two[0]) + one[3][:, None]
        may = near >= vectors.least_products(two[2], 64, 0.98, vectors.FAILURE)
        assert np.diag(may).all() and may.mean() < 0.003  # all but the diagonal are unlike
    assert vectors.confidence(3, 1e-9) == 1.0 > vectors.confidence(16, 1e-9) > vectors.confidence(64, 1e-9)


def test_planted_links_by_the_registered_parameters(spark):
    """More vectors of a label than one bucket takes: pairs around the threshold, a crowd,
    copies; links, degrees and components equal those of all pairs."""
    draw = np.random.default_rng(1)
    a, b = pairs_at(draw.uniform(0.9795, 0.9815, (2500, 1)), 2500, 64, draw)
    crowd = a[0] + 0.02 / np.sqrt(8) * draw.standard_normal((300, 64))
    rest = draw.standard_normal((3000, 64))
    every = np.concatenate([a, b, crowd, rest, np.repeat(a[5:6], 50, 0)]).astype(np.float32)
    assert vectors.tables_for(len(every), 64, 0.98, vectors.MISS)[0] > 0
    frame = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(every)], "vec_id long, embedding array<float>, label int")
    extra = {n: F.lit("x") for n in ("node", "rep", "dim", "steps", "links")}
    found = {r[0]: r[1:] for r in rows_of(vectors.link_vectors(frame.withColumns(extra)), "vec_id", "n_links", "component_id")}
    units = every.astype(np.float64)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    links = []
    for at in range(0, len(units), 1000):
        i, j = np.nonzero(units[at : at + 1000] @ units.T >= 0.98)
        links += [(x, y) for x, y in zip((i + at).tolist(), j.tolist()) if x != y]
    degree, part = defaultdict(int), reachable(range(len(units)), links)
    for x, _ in links:
        degree[x] += 1
    assert found == {i: (degree[i], part[i]) for i in range(len(units))}


def test_repeated_and_null_keys_of_vectors_keep_their_rows(spark):
    v, w = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(7, v, 1), (7, w, 1), (7, v, 1), (None, v, 1), (9, w, 1), (3, v, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = rows_of(vectors.link_vectors(df), "vec_id", "n_links", "component_id")
    assert sorted(found, key=str) == sorted([(7, 2, 7), (7, 1, 7), (7, 2, 7), (None, 2, 7), (9, 1, 7), (3, 0, 3)], key=str)


# --- 3 ------------------------------------------------------------------------------------


def plain_spans(text):
    found = []
    rules = (
        ("assign", r"""(?ai:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 12),
        ("access", r"(AKIA[A-Z0-9]+)", 18),
        ("hex", r"([0-9a-f]+)", 16),
    )
    for kind, pattern, least in rules:
        found += [(kind, *m.span()) for m in re.finditer(pattern, text) if len(m[1]) >= least]
    return sorted(found, key=lambda s: (s[1], [r[0] for r in rules].index(s[0])))


def test_base_spans_match_the_stated_patterns():
    draw = random.Random(8)
    bits = ["password", "Secret=", "token: ", "api_key", "APIKEY='", "AKIA", "AKIAABCDEFGHIJKLMN", "0123456789abcdef", "ſecret=", "é", " ", "=", ":", "x" * 11, "y" * 12, '"', "\n"]
    for _ in range(3000):
        text = "".join(draw.choice(bits) for _ in range(draw.randint(0, 9)))
        assert secrets.base_spans(text) == plain_spans(text)


def test_literals_reach_sensitive_names():
    text = 'part = "q9w8e7r6t5"\npassword = part + "u4i3o2p1"\nnote = "plain words here"\nclientSecret := "short"\n'
    found = [text[a:b] for kind, a, b, *_ in secrets.spans_of(text) if kind == "literal"]
    assert found == ["q9w8e7r6t5", "u4i3o2p1"]
    assert secrets.literal_spans("token: international\nkey = example1234567890") == []
    assert secrets.literal_spans('{"dbPassword": "zz88yy77xx66"}')[0][3] == "dbPassword"
    assert secrets.spans_of("") == [] and secrets.literal_spans("=:" * 50) == []


@pytest.mark.parametrize(
    "form",
    [
        'api_token: str = "VALUE"',
        'def f(password: Optional[str] = "VALUE"): pass',
        'token: dict[str, list[str]] = "VALUE"',
        'const dbPassword: string = "VALUE"',
        "let secret: string | null = 'VALUE'",
        'const TOKEN: &\'static str = "VALUE";',
        'val password: String? = "VALUE"',
        'token?: string = "VALUE"',
        'else: password = "VALUE"',
        'os.environ["DB_PASSWORD"] = "VALUE"',
        "config['db']['password'] = 'VALUE'",
        "config[ 'password' ] := 'VALUE'",
        "array('password' => 'VALUE')",
        "connect :password => 'VALUE', :host => 'x'",
        "password=>'VALUE'",
    ],
)
def test_literals_of_typed_subscript_and_arrow_forms(form):
    value = "q9w8!e7r6#t5y4"
    text = form.replace("VALUE", value)
    assert [text[a:b] for _, a, b, *_ in secrets.literal_spans(text)] == [value]


def test_colons_that_are_no_types_keep_their_values():
    for text, value in (
        ("dbPassword: c2VjcmV0cGFzc3dv12=\n", "c2VjcmV0cGFzc3dv12="),
        ("dbPassword: hunter2hunter2x = other", "hunter2hunter2x"),
        ('password: q9w8e7r6t5y4\nnote = "plain words"', "q9w8e7r6t5y4"),
    ):
        assert [text[a:b] for _, a, b, *_ in secrets.literal_spans(text)] == [value]
    assert secrets.literal_spans('rows[0] = "q9w8e7r6t5y4"; note: str = "q9w8e7r6t5y4"; if x != "q9w8e7r6t5y4"') == []


def test_constants_that_double_or_grow_stay_small():
    text = 'x = "abcd1234"\n' + "x = x + x\n" * 40 + "password = x\n"
    began = time.perf_counter()
    assert [text[a:b] for _, a, b, *_ in secrets.literal_spans(text)] == ["abcd1234"]
    assert time.perf_counter() - began < 1
    lines = [f's = s + "q{i}z"' for i in range(100_000)]
    text = 's = "a1b2"\n' + "\n".join(lines) + "\ntoken = s"
    began = time.perf_counter()
    spans = secrets.literal_spans(text)
    assert time.perf_counter() - began < 3 and len(spans) == 100_001
    assert {text[a:b] for _, a, b, *_ in spans} == {"a1b2", *(f"q{i}z" for i in range(100_000))}
    text = 'password = "a1"\n' + "\n".join(f'password = password + "q{i}z"' for i in range(20_000))
    began = time.perf_counter()
    assert len(secrets.literal_spans(text)) == 20_001 and time.perf_counter() - began < 3


def test_a_constant_counts_for_the_most_sensitive_name_it_reaches():
    text = 'part = "q9w8e7r6t5y4"\nauthKey = part\nother = part + "u7i8"\npassword = other\nother = "plain"\n'
    found = {text[a:b]: name for _, a, b, name, _ in secrets.literal_spans(text)}
    assert found == {"q9w8e7r6t5y4": "password", "u7i8": "password"}
    assert secrets.literal_spans('part = "changeme"\npassword = part + "q9w8e7r6t5"') == []


def test_secret_digests_of_a_table_equal_plain_patterns(spark, tmp_path):
    draw = random.Random(21)
    bits = ["password", "Secret=", "token: ", "AKIA", "AKIAABCDEFGHIJKLMN", "0123456789abcdef", "é", " ", "=", "x" * 12, '"', "\n", "key"]
    texts = ["".join(draw.choice(bits) for _ in range(draw.randint(0, 14))) for _ in range(400)] + [None, "", "a" * 50_000]
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame([*rows, rows[0]], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    names = ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    found = rows_of(op3_secret_scan(spark, str(tmp_path)), *names)
    assert len(found) == len(rows) + 1
    for d, *counts, digest, spans in found:
        base = plain_spans(texts[d] or "")
        assert counts == [sum(s[0] == k for s in base) for k in ("assign", "access", "hex")]
        told = [":".join(map(str, s)) for s in base]
        assert digest == hashlib.sha256(",".join(told).encode()).hexdigest()
        every = spans.split(",") if spans else []
        assert [s for s in every if not s.startswith("literal:")] == told
        starts = [int(s.split(":")[1]) for s in every]
        assert starts == sorted(starts)


def test_scan_and_redaction_keep_rows(spark, docs):
    secret = "é password = hunter2hunter2 end 0123456789abcdef0"
    df = docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit(secret)))
    found = secrets.scan_secrets(df, "doc_id", "text")
    assert found.count() == df.count()
    spans = found.where("doc_id IS NULL").select(spans_text(F.col("spans"))).collect()[0][0]
    assert spans == "assign:2:27,hex:32:49"
    masked = secrets.redact_secrets(df, "text")
    assert masked.columns == df.columns and masked.count() == df.count()
    assert masked.where("doc_id IS NULL").collect()[0]["text"] == "é [SECRET] end [SECRET]"
    assert masked.where("text IS NULL").count() == df.where("text IS NULL").count()
    assert secrets.scan_secrets(df.limit(0), "doc_id", "text").count() == 0


# --- 4 and 10 -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    ranks = bpe.encoder(bpe.read_ranks(RANKS)).ranks
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_slices_and_merges_match_the_library(library):
    own = bpe.encoder(bpe.read_ranks(RANKS))
    draw = random.Random(1)
    alphabet = [*" \t\n\r'stmdrevlabcS1²½é漢?!.́🙂", "'s", "'re", "  ", "\n\n", "\u0085", "\x1c", "　", "\0"]
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 60))) for _ in range(4000)]
    texts += ["", "a" * 3000, " " * 999, "the" * 400]
    ids, starts = own.encode(texts)
    for text, a, b in zip(texts, starts, starts[1:]):
        assert ids[a:b].tolist() == library.encode_ordinary(text), text
        assert bpe.decode(ids[a:b], own) == text.encode()


def test_encoded_tables_round_trip_with_offsets(spark, docs, library):
    ranks = bpe.read_ranks(RANKS)
    encoded = bpe.encode_texts(docs, "doc_id", "text", ranks)
    texts = sorted(((d, t or "") for d, t in rows_of(docs, "doc_id", "text")))
    found = sorted(rows_of(encoded, "doc_id", "ids", "offsets"), key=lambda r: r[0])
    assert len(found) == len(texts)
    for (_, text), (_, packed, offsets) in zip(texts, found):
        ids = np.frombuffer(packed, "<u4").tolist()
        assert ids == library.encode_ordinary(text)
        sizes = [len(library.decode_single_token_bytes(i)) for i in ids]
        assert offsets == np.cumsum([0, *sizes])[:-1].tolist()
    decoded = bpe.decode_ids(encoded, "doc_id", "ids", ranks)
    assert sorted((d, bytes(x).decode()) for d, x in rows_of(decoded, "doc_id", "decoded")) == texts
    assert bpe.encode_texts(docs.limit(0), "doc_id", "text", ranks).count() == 0


def test_query_digests(spark, sf_dir, library):
    texts = dict(rows_of(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text"))
    for row in op4_byte_bpe(spark, sf_dir).collect():
        ids = np.array(library.encode_ordinary(texts[row["doc_id"]]), "<u4")
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(texts[row["doc_id"]].encode()).hexdigest()


def test_token_files_count_every_document(spark, docs, library):
    counted = token_files.documents_token_counts(docs, "doc_id", "text", bpe.read_ranks(RANKS), SEPARATOR)
    expected = sorted((d, len(library.encode_ordinary(t or ""))) for d, t in rows_of(docs, "doc_id", "text"))
    assert sorted(rows_of(counted, "doc_id", "n_tokens")) == expected


def test_token_counts_do_not_depend_on_how_later_scans_are_split(spark, library, tmp_path, monkeypatch):
    """Settings that split the table otherwise change between writing and counting."""
    texts = [None if i % 17 == 3 else f"text {i} " * (i % 40) for i in range(3000)]
    frame = spark.createDataFrame([(i if i % 11 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    frame.repartition(6).write.parquet(f"{tmp_path}/t")
    count = token_files.count_tokens

    def otherwise(*args):
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        return count(*args)

    monkeypatch.setattr(token_files, "count_tokens", otherwise)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        table = spark.read.parquet(f"{tmp_path}/t")
        counted = token_files.documents_token_counts(table, "doc_id", "text", bpe.read_ranks(RANKS), SEPARATOR)
        found = rows_of(counted, "doc_id", "n_tokens")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    expected = [(i if i % 11 else None, len(library.encode_ordinary(t or ""))) for i, t in enumerate(texts)]
    assert sorted(found, key=str) == sorted(expected, key=str)


def test_token_counts_keep_text_keys_and_empty_tables(spark, library):
    rows = [("a b", "one two"), (None, "x"), ("P\u00c4", None), ("", "y"), ("a b", "one two")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    ranks = bpe.read_ranks(RANKS)
    found = rows_of(token_files.documents_token_counts(df, "doc_id", "text", ranks, SEPARATOR), "doc_id", "n_tokens")
    assert sorted(found, key=str) == sorted(((k, len(library.encode_ordinary(t or ""))) for k, t in rows), key=str)
    assert token_files.documents_token_counts(df.limit(0), "doc_id", "text", ranks, SEPARATOR).count() == 0


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1 << 18])
def test_blocks_are_stitched(spark, block):
    path = shared_folder(spark)
    ids = [5, 0xC4, 9, 3, 9, 9, 0x0950, 0x5009, 7, 9, 8, 8, 8, 8, 8]  # bytes of 9 across ids
    data = np.array(ids, "<u2").tobytes()
    frame = spark.createDataFrame([(bytearray(data),)], "value binary").select(F.col("value").cast("string"))
    frame.coalesce(1).write.option("lineSep", "\t\0").option("encoding", "ISO-8859-1").text(path)
    found = sorted(rows_of(token_files.count_tokens(spark, path, 9, block), "document", "n_tokens"))
    assert found == [(0, 2), (1, 1), (2, 0), (3, 3), (4, 5)]


@pytest.mark.parametrize("arrow", [True, False])
def test_blocks_of_one_file_are_dealt_to_many_tasks(spark, tmp_path, monkeypatch, arrow):
    monkeypatch.setattr(token_files, "TOGETHER", 2)
    monkeypatch.setattr(token_files, "TASK", 1000)
    if not arrow:
        monkeypatch.setattr(token_files, "_opens", lambda path: False)
    ids = np.random.default_rng(3).integers(0, 12, 20_001).astype("<u2")
    folder = tmp_path / "a folder"
    folder.mkdir()
    (folder / "part-00000.txt").write_bytes(ids.tobytes())
    (folder / "part-00001.txt").write_bytes(b"")
    scanned = token_files.scan_blocks(spark, str(folder), 9, 100)
    assert (scanned.select(F.spark_partition_id()).distinct().count() > 20) == arrow
    assert sorted(rows_of(scanned, "block", "tokens")) == [(i, 100) for i in range(200)] + [(200, 1)]
    cuts = [-1, *np.flatnonzero(ids == 9).tolist(), len(ids)]
    sizes = [b - a - 1 for a, b in zip(cuts, cuts[1:])]
    found = sorted(rows_of(token_files.count_tokens(spark, str(folder), 9, 100), "document", "n_tokens"))
    assert found == list(enumerate(sizes if ids[-1] != 9 else sizes[:-1]))
    (folder / "part-00002.txt").write_bytes(b"odd")
    with pytest.raises(Exception, match="whole ids"):
        token_files.scan_blocks(spark, str(folder), 9, 100).collect()


# --- 5 ------------------------------------------------------------------------------------


def test_shards_are_gapless_stable_and_grow_into_the_new_one(spark, docs):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    out = sharding.assign_shards(df, "doc_id", "text", [1.0] * 6, [1.0] * 7)
    rows = rows_of(out, "doc_id", "shard", "slot", "grown_shard")
    assert all(g in (s, 6) for _, s, _, g in rows)
    moved = sum(g == 6 for *_, g in rows)
    assert abs(moved - 3000 / 7) < 100
    slots = defaultdict(list)
    for _, s, slot, _ in rows:
        slots[s].append(slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and len(slots) == 6
    weighted = sharding.assign_shards(df, "doc_id", "text", [3.0, 1.0, 0.0])
    sizes = dict(rows_of(weighted.groupBy("shard").count(), "shard", "count"))
    assert 2 not in sizes and abs(sizes[0] - 2250) < 120
    awkward = sharding.assign_shards(docs, "doc_id", "text", [1.0, 1.0])
    by_id = {r[0]: r[1:] for r in rows_of(awkward, "doc_id", "size", "text_crc32", "grown_shard")}
    assert awkward.count() == docs.count()
    for d, t in rows_of(docs, "doc_id", "text"):
        data = (t or "").encode()
        assert by_id[d] == (len(data) + 8, zlib.crc32(data), None)
    assert sharding.assign_shards(docs.limit(0), "doc_id", "text", [1.0]).count() == 0


# --- 6 ------------------------------------------------------------------------------------


def shingles(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def check_jaccard(df):
    texts = dict(rows_of(df, "doc_id", "text"))
    sets = {d: shingles(t) for d, t in texts.items()}
    links = []
    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and x and y and 100 * len(x & y) >= 80 * len(x | y):
                links.append((a, b))
    part = reachable(texts, links)
    found = rows_of(jaccard.jaccard_components(df, "doc_id", "text"), "doc_id", "n_shingles", "component_id")
    assert len(found) == df.count()
    assert set(found) == {(d, len(sets[d]), part[d]) for d in texts}


def test_jaccard_components_match_all_pairs_on_awkward_rows(docs):
    check_jaccard(docs)
    assert jaccard.jaccard_components(docs.limit(0), "doc_id", "text").count() == 0


def test_jaccard_components_match_all_pairs_in_a_crowd(spark, monkeypatch):
    """Many copies with a few edits each, around the threshold, and a passage all share;
    frequencies count early and blocks are small."""
    monkeypatch.setattr(jaccard, "FREQUENT", 4)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(5))
    base, passage, texts = [word() for _ in range(70)], [word() for _ in range(20)], []
    for i in range(150):
        words = list(base) if i % 3 else [word() for _ in range(60)]
        for _ in range(draw.randint(0, 3) if i % 3 else 0):
            words[draw.randrange(len(words))] = word()
        texts.append(" ".join(words + (passage if i % 2 else [])))
    check_jaccard(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5))


def regular(length, a="a", b="b"):
    """Each half is the other with its two letters swapped: sums with powers of any odd
    number cancel out modulo powers of two."""
    text = a
    while len(text) < length:
        text += text.translate(str.maketrans(a + b, b + a))
    return text


def test_words_and_sequences_of_a_regular_pattern_stay_apart(spark):
    one, two = regular(1024), regular(1024, "b", "a")
    rest = [f"x{i}" for i in range(6)]
    texts = [one, two, " ".join([*rest, one]), " ".join([*rest, two]), " ".join(one), " ".join(two)]
    check_jaccard(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    import pyarrow as pa

    from tabgrove.llm.common import utf8

    grams = [importance.features(*utf8(pa.array([t])), 1 << 20)[0].tolist() for t in (one, two)]
    assert grams[0][0] != grams[1][0]


@pytest.mark.parametrize("percent", [80, 50, 100])
def test_long_lists_of_many_sizes_are_compared_by_bands(spark, monkeypatch, percent):
    """One frequent beginning in texts of 5 to 80 words, whose sizes are most of what
    tells them apart; every list is cut into bands and blocks."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    words = [f"w{i}" for i in range(100)]
    texts = [" ".join(words[: 5 + i % 76] + ["end"] * (i % 2)) for i in range(220)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sets = [shingles(t) for t in texts]
    links = [
        (a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    part = reachable(range(len(sets)), links)
    found = dict(rows_of(jaccard.jaccard_components(df, "doc_id", "text", percent=percent), "doc_id", "component_id"))
    assert found == part


# --- 7 ------------------------------------------------------------------------------------


def test_sketches_of_texts_and_edits(spark, docs):
    out = sketch.spliced(docs, "doc_id", "text", scale=1)
    texts = dict(rows_of(docs, "doc_id", "text"))
    order = sorted(texts)
    found = rows_of(out, "doc_id", "n_chars", "edited", "own", "edit", "next")
    assert len(found) == docs.count()
    sizes = dict(rows_of(docs.select("doc_id", F.size(sketch.sketch(F.col("text"), 1)).alias("n")), "doc_id", "n"))
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    for d, n, edited, own, edit, following in found:
        text, after = texts[d] or "", texts[order[(order.index(d) + 1) % len(order)]] or ""
        assert n == len(text) and edited == text[: n - n // 2] + after[: n // 2]
        mine = words(text)
        assert len(own) == len({tuple(mine[i : i + 5]) for i in range(max(len(mine) - 4, min(1, len(mine))))}) == sizes[d]
        assert own == sorted(own) and (text != edited or own == edit)
        assert len(following) == sizes[order[(order.index(d) + 1) % len(order)]]


def test_sketch_estimates_containment_and_merges(spark):
    words = [f"w{i}" for i in range(6000)]
    df = spark.createDataFrame([(" ".join(words[:1500]), " ".join(words))], "a string, b string")
    a, b = (sketch.sketch(F.col(c)) for c in "ab")
    near, back, merged, alone = df.select(
        sketch.containment(a, b), sketch.containment(b, a), F.size(sketch.merge(a, b)), F.size(b)
    ).collect()[0]
    assert near == 1.0 and abs(back - 0.25) < 0.08 and merged == alone
    assert spark.range(1).select(sketch.containment(sketch.sketch(F.lit(None).cast("string")), F.array(F.lit(1).cast("long")))).collect()[0][0] is None


def cut(text):
    mine = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(mine[i : i + 5]) for i in range(max(len(mine) - 4, min(1, len(mine))))}


def read_fingerprint(text):
    data = base64.b64decode(text)
    return [int.from_bytes(data[i : i + 4], "big") for i in range(0, len(data), 4)]


def test_registered_sketches_hold_short_texts_whole(spark, tmp_path):
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words[:20]), " ".join(words[:16]), "a b c d e", "a b c d e f", "one", None, " ".join(words)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    rows = rows_of(op7_scaled_sketch(spark, str(tmp_path)), "doc_id", "fingerprint", "near_edited", "near_next")
    assert len(rows) == len(texts)
    for d, fingerprint, near_edited, near_next in rows:
        text, after = texts[d] or "", texts[(d + 1) % len(texts)] or ""
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        assert read_fingerprint(fingerprint) == sorted(
            int(hashlib.md5(" ".join(s).encode()).hexdigest()[:8], 16) for s in cut(text)
        )
        for found, other in ((near_edited, edited), (near_next, after)):
            expected = len(cut(text) & cut(other)) / len(cut(text)) if cut(text) else float(text == other)
            assert found == pytest.approx(expected)


def test_registered_sketches_estimate_containment_within_their_error(spark, tmp_path):
    """Long texts hold a quarter of their hashes. Estimates lie within five of the stated
    deviations, and fingerprints are shorter than texts."""
    draw = random.Random(12)
    word = lambda: "".join(draw.choice("abcdefghijklmnop") for _ in range(6))
    texts = []
    for i in range(60):
        words = [word() for _ in range(draw.choice([90, 400, 3000]))]
        texts.append(" ".join(words))
        texts.append(" ".join(words[: draw.randint(40, len(words))] + [word() for _ in range(draw.randint(0, 2000))]))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    rows = rows_of(op7_scaled_sketch(spark, str(tmp_path)), "doc_id", "fingerprint", "near_edited", "near_next")
    deviations = []
    for d, fingerprint, near_edited, near_next in rows:
        text, after = texts[d], texts[(d + 1) % len(texts)]
        edited, mine, held = text[: len(text) - len(text) // 2] + after[: len(text) // 2], cut(text), read_fingerprint(fingerprint)
        assert 0 < len(held) < len(mine) and len(fingerprint) < len(text) and max(held) < 2**30
        assert abs(len(held) - len(mine) / 4) <= 5 * (len(mine) * 3 / 16) ** 0.5
        for found, other in ((near_edited, edited), (near_next, after)):
            share = len(mine & cut(other)) / len(mine)
            error = (share * (1 - share) / len(held)) ** 0.5
            assert abs(found - share) <= 5 * error + 1e-9
            deviations += [(found - share) / error] if error else []
    assert abs(np.mean(deviations)) < 0.5 and 0.5 < np.std(deviations) < 1.5


def test_sketches_of_unequal_texts_go_by_common_hashes(spark):
    """A short text holds every hash, a long one a quarter: shares go by the quarter."""
    words = [f"w{i}" for i in range(3000)]
    df = spark.createDataFrame([(" ".join(words[100:160]), " ".join(words))], "a string, b string")
    a, b = (sketch.sketch(F.col(c)) for c in "ab")
    row = df.select(sketch.containment(a, b).alias("c"), F.size(a).alias("n"), sketch.resemblance(a, b).alias("r")).collect()[0]
    assert (row["c"], row["n"]) == (1.0, 56) and 0 < row["r"] < 0.06


# --- 8 ------------------------------------------------------------------------------------


def fair_targets(sizes, weights, share, most):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, open_ = {}, set(names)
    while True:
        left = share * sum(sizes.values()) - sum(fixed.values())
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not full:
            return fixed | {s: level * weight[s] for s in open_}
        fixed |= {s: most * sizes[s] for s in full}
        open_ -= full


def test_mix_comes_near_its_targets(spark):
    draw = random.Random(6)
    data = [(i, " w" * draw.randint(0, 90), ("a", "b", "c", "d", None)[min(4, i % 9)]) for i in range(700)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(3)
    mixed = mixing.mix(df, "doc_id", "text", "source")
    rows = rows_of(mixing.taken_words(mixed), "key", "size", "source_size", "target", "taken")
    sizes, source = defaultdict(int), {i: s for i, _, s in data}
    for i, text, s in data:
        sizes[s] += text.count("w")
    targets = fair_targets(sizes, (5, 2, 1), 1.5, 2)
    taken = defaultdict(int)
    for key, size, source_size, target, words in rows:
        assert size == data[key][1].count("w") and source_size == sizes[source[key]]
        assert target == pytest.approx(targets[source[key]])
        assert 0 <= words <= 2 * size
        taken[source[key]] += words
    assert len(rows) == 700
    for s, target in targets.items():
        assert abs(taken[s] - target) <= max(0.03 * target, 4 * mixed.block_words)
    again = mixing.mix(df.repartition(5), "doc_id", "text", "source")
    assert sorted(rows_of(mixing.taken_words(again), "key", "taken")) == sorted((r[0], r[4]) for r in rows)
    # Any run of slots holds every source in about its share.
    slots = dict(rows_of(mixed.schedule, "slot", "source"))
    start = [slots[i] for i in range(len(slots) // 4)]
    for s, target in targets.items():
        assert abs(start.count(s) - len(start) * target / sum(targets.values())) <= 6


def test_sources_far_below_a_block_get_their_targets(spark):
    sizes = {"a": 40_000, "b": 300, "c": 7, "d": 150, "e": 1, "f": 90}
    data = [(s, "w " * 50 if n > 50 else "w " * n) for s, n in sizes.items() for _ in range(max(1, n // 50))]
    df = spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(data)], "doc_id long, text string, source string")
    mixed = mixing.mix(df, "doc_id", "text", "source", block_words=412)
    rows = mixing.taken_words(mixed).join(df.select(F.col("doc_id").alias("key"), "source"), "key")
    found = rows.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"))
    for source, taken, target in rows_of(found, "source", "taken", "target"):
        assert abs(taken - target) <= 0.5, source
    slots = sorted(rows_of(mixed.schedule, "slot"))
    assert slots == [(i,) for i in range(len(slots))]
    assert mixed.schedule.select("source", "block").distinct().count() == len(slots)


def test_schedule_points_stay_evenly_spread(spark):
    n = 1 << 24
    points = np.arange(n, dtype=np.uint64) * np.uint64(mixing.GOLDEN) & np.uint64(2**mixing.BITS - 1)
    assert np.diff(np.sort(points)).max() / 2**mixing.BITS * n < 2
    slots = [0, 1, 2**30 - 1, 2**30, 2**33 + 7, 2**45 + 3]
    df = spark.createDataFrame([(x,) for x in slots], "slot long").select("slot", mixing.point(F.col("slot")).alias("p"))
    assert dict(rows_of(df, "slot", "p")) == {x: x * mixing.GOLDEN % 2**mixing.BITS for x in slots}


def test_mixed_texts_are_whole_or_first_words(spark):
    rows = [(i, ("w%d " % i) * (i % 7), ("a", "b", None)[i % 3]) for i in range(90)] + [(90, None, "a"), (0, "again a b", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df = df.withColumns({n: F.lit("x") for n in ("key", "taken", "size", "copies", "whole", "left", "copy", "words")})
    mixed = mixing.mix(df, "doc_id", "text", "source")
    out = mixing.mixed_texts(df, "doc_id", "text", mixed)
    assert out.columns == [*df.columns, "is_part"]
    taken = defaultdict(int)
    for text, source, part in rows_of(out, "text", "source", "is_part"):
        taken[source] += len((text or "").split())
        assert part is False or text
    targets = dict(rows_of(mixed.targets, "source", "target"))
    assert all(abs(taken[s] - targets[s]) <= 2 for s in targets)
    wordless = {d for d, t, _ in rows if not (t or "").split()}
    kept = [d for (d,) in rows_of(out, "doc_id") if d in wordless and d != 0]
    assert sorted(kept) == sorted(wordless - {0})


def test_mix_of_awkward_rows(docs):
    mixed = mixing.mix(docs, "doc_id", "text", "source")
    rows = rows_of(mixing.taken_words(mixed), "size", "taken")
    assert len(rows) == docs.count() and all(t <= 2 * s for s, t in rows)
    empty = mixing.mix(docs.limit(0), "doc_id", "text", "source")
    assert mixing.taken_words(empty).count() == 0


# --- 9 ------------------------------------------------------------------------------------


def test_best_paths_of_trees(spark):
    nodes = [("t", 1, None, 1.0), ("t", 2, 1, 5.0), ("t", 3, 1, 1.0), ("t", 4, 3, 4.5), ("t", 5, 4, None), ("t", 6, 99, 0.0)]
    nodes += [(None, 1, None, 0.0), (None, 2, 1, 0.0)] + [("deep", i, i - 1 if i else None, 1.0) for i in range(37)]
    df = spark.createDataFrame(nodes, "tree string, node long, parent long, score double")
    best = rows_of(chat.choose_paths(df), "tree", "leaf", "depth", "node")
    assert sorted(r[2:] for r in best if r[0] == "t") == [(0, 5), (1, 4), (2, 3), (3, 1)]
    assert sorted(r[2:] for r in best if r[0] is None) == [(0, 2), (1, 1)]
    assert sorted(r[2:] for r in best if r[0] == "deep") == [(36 - i, i) for i in range(36, -1, -1)]
    every = rows_of(chat.choose_paths(df, top=None), "tree", "leaf", "rank")
    assert {r[1:] for r in every if r[0] == "t"} == {(5, 0), (2, 1), (6, 2)}
    assert chat.choose_paths(df.limit(0)).count() == 0
    ring = spark.createDataFrame([("t", 1, 2, 0.0), ("t", 2, 1, 0.0)], df.schema)
    with pytest.raises(ValueError, match="cycle"):
        chat.choose_paths(ring)


def test_formatting_is_reversible():
    draw = random.Random(7)
    bits = ["### ", "user: ", " </turn>\n", "\\", "\\\\", "#", "<", "é", "\n", "assistant", ":"]
    for _ in range(500):
        text = lambda: "".join(draw.choice(bits) for _ in range(draw.randint(0, 8)))
        turns = [(draw.choice(["user", "assistant", text()]), text()) for _ in range(draw.randint(0, 5))]
        formatted, spans = chat.render(turns)
        assert chat.parse(formatted) == turns
        assert [chat.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    with pytest.raises(ValueError):
        chat.parse("### user: x")


def test_conversations_with_nulls_and_ties(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "hi"), (1, 1, None, "tie"), (None, 0, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    messages = chat.linear_trees(df)
    out = chat.format_paths(chat.choose_paths(messages), messages)
    found = {tree: chat.parse(text) for tree, text in rows_of(out, "tree", "formatted")}
    assert found == {1: [("user", "hi"), ("", "tie"), ("assistant", "")], None: [("assistant", "x")]}


def test_conversations_with_repeats_long_texts_and_clashing_names(spark):
    rows = [(1, 0, "user", t) for t in ("b", "a", "b", None, "")] + [(1, 1, "assistant", "x" * 300_000), (2, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    df = df.withColumns({n: F.lit("y") for n in ("tree", "node", "at", "mark", "leaf", "rank", "total", "up")})
    messages = chat.linear_trees(df)
    out = chat.format_paths(chat.choose_paths(messages), messages)
    found = {tree: chat.parse(text) for tree, text in rows_of(out, "tree", "formatted")}
    # Of one turn and role: NULL, then by the md5 of the text.
    texts = sorted(("b", "a", "b", ""), key=lambda t: hashlib.md5(t.encode()).hexdigest())
    assert found == {1: [("user", t) for t in ("", *texts)] + [("assistant", "x" * 300_000)], 2: [("", "")]}
    assert chat.linear_trees(df.limit(0)).count() == 0
