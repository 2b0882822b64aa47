"""Token alignment, vector codes and languages against brute force, with odd rows."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from diffsieve.llm import language_spans, token_alignment, vector_codes

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id bigint, text string, lang string, block int, pairs string, `__id` int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "x", 2) for i, t, lang in rows], DOCS)


# ---- token alignment -------------------------------------------------------------------------------------------------


def plain_tokens(text):
    """Ids and bytes of both libraries' tokens, or None."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    if not text:
        return None
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    char = {b_: chr(b_) for b_ in own} | {b_: chr(256 + k) for k, b_ in enumerate(x for x in range(256) if x not in own)}
    byte = {c: b_ for b_, c in char.items()}
    bytes_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    whole = (" " + text).encode()
    return (ids_a, bytes_a, ids_b, bytes_b) if b"".join(bytes_a) == whole == b"".join(bytes_b) else None


def plain_groups(text):
    tokens = plain_tokens(text)
    if tokens is None:
        return []
    ids_a, bytes_a, ids_b, bytes_b = tokens
    ends_a, ends_b = list(itertools.accumulate(map(len, bytes_a))), list(itertools.accumulate(map(len, bytes_b)))
    groups, start = [], 0
    for end in sorted(set(ends_a) & set(ends_b)):
        groups.append(([i for i, e in zip(ids_a, ends_a) if start < e <= end], [i for i, e in zip(ids_b, ends_b) if start < e <= end]))
        start = end
    return groups


def plain_digest(texts):
    groups = [plain_groups(t) for t in texts]
    links = [Counter((a, b) for x, y in g for a in x for b in y) for g in groups]
    held = Counter(p for x in links for p in x)
    most = {}
    for (a, _), n in held.items():
        most[a] = max(most.get(a, 0), n)
    for g, x in zip(groups, links):
        written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        yield (
            sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(x.values()),
            sum(n for p, n in x.items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in x.items()),
            hashlib.sha256(written.encode()).hexdigest() if g else "")


def strange_texts(n):
    rng = random.Random(11)
    ranges = [(32, 127), (0, 0x300), (0x300, 0x3000), (0x3000, 0xD7FF), (0x10000, 0x1FFFF), (32, 33), (9, 11)]
    pool = [chr(rng.randrange(*rng.choice(ranges))) for _ in range(900)]
    return ["".join(rng.choices(pool, k=rng.randrange(1, 60))) for _ in range(n)]


TEXTS = [
    None, "", " ", "\n\t  ", "a", "a", "the cat sat", "the cat sat", "the the the dog", "<|endoftext|> <s> </s>", "bad ▁ sign", "a\x00b", "ß漢字😀é",
    "=" * 700, "- = " * 300, "supercalifragilistic " * 40, "x" * 500, " lead and trail ", *strange_texts(60)]


def test_alignment_equals_brute_force(spark):
    rows = [(i if i != 5 else None, t, None) for i, t in enumerate(TEXTS)]
    got = token_alignment.alignment_digest(docs_of(spark, rows), A, B).collect()
    assert len(got) == len(TEXTS)
    want = sorted((str(i), *x) for (i, _, _), x in zip(rows, plain_digest(TEXTS)))
    assert sorted((str(r[0]), *r[1:]) for r in got) == want
    assert {r["doc_id"]: r["n_links"] for r in got}[10] == 0  # the sign of a blank is not given back


def test_repeated_ids_are_documents_each(spark):
    got = token_alignment.alignment_digest(docs_of(spark, [(1, "cat", None), (1, "cat", None), (None, "cat dog", None)]), A, B)
    want = sorted(plain_digest(["cat", "cat", "cat dog"]))
    assert sorted(tuple(r[1:]) for r in got.collect()) == want


def test_aligned_tokens_and_overlaps(spark):
    texts = ["the unbelievable cat", None, "ß漢字😀é", "=" * 90]
    rows = {r["doc_id"]: r for r in token_alignment.align(docs_of(spark, [(i, t, None) for i, t in enumerate(texts)]), A, B).collect()}
    for i, text in enumerate(texts):
        tokens, row = plain_tokens(text), rows[i]
        if tokens is None:
            assert not any(row[c] for c in row.asDict() if c != "doc_id")
            continue
        ids_a, bytes_a, ids_b, bytes_b = tokens
        assert (row["a_ids"], row["b_ids"]) == (ids_a, ids_b)
        assert [*zip(row["a_sizes"], row["b_sizes"])] == [(len(a), len(b)) for a, b in plain_groups(text)]
        spans_a, spans_b = ([(e - n, e) for n, e in zip(map(len, x), itertools.accumulate(map(len, x)))] for x in (bytes_a, bytes_b))
        assert [*zip(row["overlap_a"], row["overlap_b"])] == [
            (x, y) for x, (s, e) in enumerate(spans_a) for y, (u, v) in enumerate(spans_b) if max(s, u) < min(e, v)]


@pytest.mark.parametrize("work", [1, 2, 7, 128])
def test_merge_pieces_of_any_work_agree(work):
    rng = np.random.default_rng(work)
    for n, m, top in [(1, 1, 1), (1, 40, 40), (40, 1, 90), (300, 200, 500), (50, 50, 60)]:
        a = np.sort(rng.choice(np.arange(1, top), min(n, top) - 1, replace=False)) if top > 1 else np.empty(0, np.int64)
        b = np.sort(rng.choice(np.arange(1, top), min(m, top) - 1, replace=False)) if top > 1 else np.empty(0, np.int64)
        a, b = np.r_[a, top].astype(np.int64), np.r_[b, top].astype(np.int64)
        over_a, over_b, group_a, group_b = token_alignment.merge(a, b, work)
        shared = np.intersect1d(a, b)
        assert (group_a == np.searchsorted(shared, a)).all() and (group_b == np.searchsorted(shared, b)).all()
        plain = [(i, j) for i in range(len(a)) for j in range(len(b)) if max(np.r_[0, a][i], np.r_[0, b][j]) < min(a[i], b[j])]
        assert [*zip(over_a.tolist(), over_b.tolist())] == plain
        i, j = token_alignment.crossings(a, b, work)
        assert (np.diff(np.r_[i + j, len(a) + len(b)]) <= work).all()  # equal work, but for the last


def test_long_texts_in_stretches_and_large_groups(spark, monkeypatch):
    text = "words and,  more words 123 " * 30 + "=" * 40 + " end"
    files = token_alignment.Vocabularies(A, B)
    ids_a, _, ids_b, _ = plain_tokens(text)
    for long in (50, 10**6):
        monkeypatch.setattr(token_alignment, "LONG", long)
        assert files.encoder()([text, ""]) == [(ids_a, ids_b), ([], [])]
    x = token_alignment.aligner(files)([text, "", "=-" * 200 + "é" * 300])
    few = Counter()
    for t, p, n in zip(*token_alignment.links_of(x)):
        few[int(t), int(p)] += int(n)
    monkeypatch.setattr(token_alignment, "LISTED", 0)
    many = Counter()
    for t, p, n in zip(*token_alignment.links_of(x)):
        many[int(t), int(p)] += int(n)
    assert few == many


def test_both_libraries_give_the_ids_of_the_vocabulary(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    rng = random.Random(8)
    pool = [chr(c) for c in (9, 10, 13, *range(32, 127), *range(0xA1, 0x250))] + list("    \n\n''") + ["'re", "'S", "the ", "tion", "<|endoftext|>", "00"]
    texts = ["".join(rng.choices(pool, k=rng.randrange(1, 80))) for _ in range(1500)]
    assert not any(token_alignment.OTHER.search(t) for t in texts)
    encode = token_alignment.Vocabularies(A, B).encoder()
    assert [a for a, _ in encode(texts)] == [library.encode(" " + t, add_special_tokens=False).ids for t in texts]


def test_alignment_of_an_empty_table(spark):
    empty = docs_of(spark, [(1, "a", None)]).where("false")
    assert token_alignment.alignment_digest(empty, A, B).collect() == []


# ---- vector codes ----------------------------------------------------------------------------------------------------


def plain_codes(rows, entries=256, rounds=4):
    """Every part against every entry, in Python's whole numbers; rows are (vec_id, vector, label)."""
    kept = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // 4
    parts = [[v[p * w : (p + 1) * w] for p in range(4)] for _, v, _ in kept]
    books = [[x[p] for x in parts[:entries]] for p in range(4)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(4):
            members = {}
            for x in parts:
                members.setdefault(near(x[p], books[p])[1], []).append(x[p])
            for e, own in members.items():
                books[p][e] = [math.floor(sum(c) / len(own)) for c in zip(*own)]
    best = [[near(x[p], books[p]) for p in range(4)] for x in parts]
    sha = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    errors = [sum(d for d, _ in b) for b in best]
    of_label = Counter()
    for (_, _, lab), e in zip(kept, errors):
        of_label[lab] += e
    return sorted((str(i), "".join(f"{e:02x}" for _, e in b), err, of_label[lab], sha) for (i, _, lab), b, err in zip(kept, best, errors))


SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, v int, salt int, `of` int"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", 1, 2, 3) for i, v, lab in rows], SCHEMA)


def f32(x):
    return float(np.float32(x))


@pytest.mark.parametrize("spread", ["clumps", "flat", "grid"])
def test_codes_equal_brute_force(spark, spread):
    rng = np.random.default_rng(3)
    n = 420
    if spread == "clumps":
        values = rng.normal(size=(30, 16))[rng.integers(0, 30, n)] + rng.normal(size=(n, 16)) * 0.05
    elif spread == "flat":
        values = rng.normal(size=(n, 16))
    else:  # few values: many ties
        values = rng.integers(-2, 3, (n, 16)) / 1024
    rows = [(int(i), [f32(x) for x in v], None if i % 7 == 0 else int(i % 3)) for i, v in enumerate(values)]
    rows += [(9_000, None, 1), (9_001, [float("nan")] * 16, 1), (9_002, [None] + [0.5] * 15, 1), (9_003, [float("inf")] * 16, 1)]
    rows += [rows[5], rows[5], (None, rows[8][1], 2)]
    got = vector_codes.compress(vectors_of(spark, rows)).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == plain_codes(rows)


def test_few_odd_and_no_vectors(spark):
    rows = [(3, [0.5, -0.5, 1.0, 2.0], 1), (1, [0.25, 0.0, -1.0, 0.125], None), (2, [1.0, 2.0], 1), (5, [], 7)]
    got = {r["vec_id"]: r for r in vector_codes.compress(vectors_of(spark, rows)).collect()}
    assert (got[2]["code"], got[2]["error"], got[5]["label_error"]) == (None, None, 0)
    assert [(got[i]["code"], got[i]["error"]) for i in (1, 3)] == [("00000000", 0), ("01010101", 0)]
    empty = vectors_of(spark, rows).where("false")
    assert vector_codes.compress(empty).collect() == []
    assert vector_codes.compress(vectors_of(spark, [(1, [], 1), (2, [], 1)])).select("code", "error").distinct().collect() == [("00000000", 0)]
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress(vectors_of(spark, [(1, [1.0, 2.0, 3.0], 1)]))
    with pytest.raises(Exception, match="too large"):
        vector_codes.compress(vectors_of(spark, [(1, [1e9, 0.0, 0.0, 0.0], 1)])).collect()


def test_cores_and_rings_spare_comparisons():
    rng = np.random.default_rng(1)
    entries = rng.integers(-1000, 1000, (256, 16))
    homes = rng.integers(0, 256, 3000)
    rows = entries[homes] + rng.integers(-60, 61, (3000, 16))
    found, compared = vector_codes.nearest_from(rows, entries, homes)
    assert (found == vector_codes.nearest(rows, entries)).all()
    assert compared < 0.02 * 3000 * 256
    # starting from wrong entries costs more but finds the same
    assert (vector_codes.nearest_from(rows, entries, (homes + 1) % 256)[0] == found).all()
    big = rows * 10**5  # beyond what doubles hold exactly
    assert (vector_codes.nearest_from(big, entries * 10**5, homes)[0] == found).all()


# ---- languages -------------------------------------------------------------------------------------------------------


def plain_best(scores, switch):
    """The best of all label paths."""
    n, k = scores.shape
    return max(
        (sum(scores[t, p] for t, p in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:])))
        for path in itertools.product(range(k), repeat=n))


def test_paths_are_the_best_of_all(spark):
    rng = np.random.default_rng(2)
    lengths = np.array([5, 0, 1, 7, 6])
    scores = rng.normal(size=(lengths.sum(), 3)) * 3
    labels = language_spans.best_paths(scores, lengths, 2.0)
    at = 0
    for n in lengths:
        own, path = scores[at : at + n], labels[at : at + n]
        if n:
            value = own[np.arange(n), path].sum() - 2.0 * (np.diff(path) != 0).sum()
            assert value == pytest.approx(plain_best(own, 2.0))
        at += n


def test_words_end_with_letters_and_scripts():
    text = "Ab c1d Привет漢字 éte ́ नमस्ते!"
    starts, ends, scripts, letters = language_spans.words_in(text)
    names = [None, *language_spans.SCRIPTS]
    assert [(text[a:b], names[s]) for a, b, s in zip(starts, ends, scripts)] == [
        ("Ab", "Latin"), ("c", "Latin"), ("d", "Latin"), ("Привет", "Cyrillic"), ("漢字", "Han"), ("éte", "Latin"), ("नमस्ते", "Devanagari")]
    assert letters[5] == 3 and len(language_spans.words_in("12 ?! ́")[0]) == 0


def sentences(words, n, seed):
    rng = random.Random(seed)
    return [" ".join(rng.choices(words, k=rng.randrange(20, 60))) for _ in range(n)]


EN = "the house with many windows stands near that river and shows light through every night".split()
DE = "das Haus mit vielen Fenstern steht nahe am Fluss und zeigt Licht durch jede Nacht".split()
RU = "дом со многими окнами стоит возле реки и светит всю ночь".split()
UK = "будинок із багатьма вікнами стоїть біля річки й світить усю ніч".split()


def test_spans_of_mixed_texts_and_odd_rows(spark):
    rows, n = [], 0
    for lang, words in (("en", EN), ("de", DE), ("ru", RU), ("uk", UK)):
        for t in sentences(words, 40, lang):
            rows.append((n, t, lang))
            n += 1
    rows += [(n, "nothing", None), (None, "no id", "en"), (n + 1, None, "en")]
    model = language_spans.fit(docs_of(spark, rows))
    assert model.languages == ["de", "en", "ru", "uk"]
    latin = model.candidates[1 + [*language_spans.SCRIPTS].index("Latin")]
    assert latin.tolist() == [True, True, False, False]
    mixed = " ".join(EN) + ". " + " ".join(DE) + " – " + " ".join(RU)
    odd = [(1, mixed, None), (2, None, None), (3, "", None), (4, "12 34 !?", None), (5, "ไทย", None), (6, "das Haus " * 30_000, None), (6, "дом", None)]
    got = language_spans.with_languages(docs_of(spark, odd), model).collect()
    assert got[0]["__id"] == 2 and got[0]["block"] == 1  # other columns stay
    text = got[0]["text"]
    assert [(text[s.start : s.end], s.lang) for s in got[0]["spans"]] == [(" ".join(EN), "en"), (" ".join(DE), "de"), (" ".join(RU), "ru")]
    assert [(r["lang_pred"], r["lang_score"]) for r in got[1:4]] == [("und", 0.0)] * 3
    assert got[4]["lang_pred"] in model.languages and 0 < got[4]["lang_score"] <= 1  # no learnt language has the script: all are candidates
    assert (got[5]["lang_pred"], got[5]["lang_score"]) == ("de", 1.0) and got[6]["lang_pred"] in ("ru", "uk")
    with pytest.raises(ValueError, match="exist already"):
        language_spans.with_languages(docs_of(spark, odd).withColumn("Spans", F.lit(1)), model)


def test_labels_of_held_out_rows_teach_nothing(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([(t, "en") for t in sentences(EN, 60, 1)] + [(t, "de") for t in sentences(DE, 60, 2)])]
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    wrong = [(i, t, "xx" if i in held else lang) for i, t, lang in rows]
    first, second = (sorted(language_spans.languages(docs_of(spark, x)).collect()) for x in (rows, wrong))
    assert first == second
    assert sorted(r["doc_id"] for r in first if r["held_out"]) == held
    assert all(r["lang_pred"] == lang for r, (_, _, lang) in zip(first, rows))
    nothing = language_spans.languages(docs_of(spark, [(1, "text", None), (None, "text", None)]))
    assert sorted((str(r[0]), r[2], r[3]) for r in nothing.collect()) == [("1", "und", 0.0), ("None", "und", 0.0)]
    assert language_spans.languages(docs_of(spark, rows).where("false")).collect() == []


def test_held_out_accuracy_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_spans.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.98
