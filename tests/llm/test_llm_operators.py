"""Every operator against brute force on small tables, with odd rows: nulls, empty and long texts, repeats, extra columns."""

import collections
import hashlib
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from diffsieve.llm import (
    decontaminate,
    embeddings,
    html_text,
    line_chunks,
    minhash,
    secret_scan,
    sentence_pieces,
    token_counts,
    toxicity,
    url_filter,
)
from diffsieve.llm.common import groups

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, label string, bucket int"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in texts], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Rows that every operator on documents must take."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    return docs_of(spark, [(1, None), (2, ""), (3, "   \n\t "), (4, "a"), (4, "a"), (None, "no id here at all"), (5, long), (6, "ß漢😀\u0000▁ é")])


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# ---- token counts and pieces -----------------------------------------------------------------------------------------


def strange_texts(n):
    rng = random.Random(5)
    ranges = [(32, 127), (0, 0x300), (0x300, 0x3000), (0x3000, 0xD7FF), (0x10000, 0x1FFFF), (32, 33), (9, 11)]
    pool = [chr(rng.randrange(*rng.choice(ranges))) for _ in range(2000)]
    return ["".join(rng.choices(pool, k=rng.randrange(1, 60))) for _ in range(n)]


def test_token_counts_equal_the_library(spark, odd):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = ["<|endoftext|>a<|endoftext|>", "  \n\n x  ", "aaaa" * 500, "I'll don't", " " * 999, *strange_texts(400)]
    count = token_counts.counter(token_counts.Merges(path))
    assert count(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    rows = token_counts.token_counts(odd, path).collect()
    assert len(rows) == odd.count()
    given = {r.doc_id: r.text or "" for r in odd.collect()}
    for r in rows:
        n = len(library.encode(given[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(given[r.doc_id].encode()), n, n > 512)


def test_pieces_without_dropout_equal_the_library_and_all_decode(spark, odd):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = sentence_pieces.Pieces(path)
    texts = ["", " ", " a  b\n", "漢字😀", *strange_texts(300)]
    plain = sentence_pieces.encoder(pieces, 0.0, 1)(texts, [0] * len(texts))
    assert all(a.tolist() == b for a, b, t in zip(plain, library.encode(texts), texts) if "▁" not in t)
    for dropout in (0.1, 0.6, 1.0):
        cut = sentence_pieces.encoder(pieces, dropout, 1)(texts, [i % 4 for i in range(len(texts))])
        assert [sentence_pieces.decode(pieces, x.tolist()) for x in cut] == texts
    encoded = sentence_pieces.encode_documents(odd, path, dropout=0.3)
    assert encoded.where("NOT lossless").count() == 0 and encoded.count() == odd.count()
    decoded = collections.Counter((r.doc_id, r.text) for r in sentence_pieces.decode_documents(encoded, path).collect())
    assert decoded == collections.Counter((r.doc_id, r.text or "") for r in odd.collect())


def test_dropout_varies_by_variant_and_repeats_by_seed():
    pieces = sentence_pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    words = [" internationalization"] * 4
    first = pieces.segment(words, [0, 1, 2, 3], 0.4, 7)
    assert len(set(first)) > 1 and first == pieces.segment(words, [0, 1, 2, 3], 0.4, 7)


def test_agenda_equals_a_plain_one():
    pieces = sentence_pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    offer = {k: (r, m) for k, r, m in zip(pieces.keys.tolist(), pieces.ranks.tolist(), pieces.made.tolist())}
    bar = int(0.3 * 2**64)

    def plain(word, variant):
        number = lambda *x: np.array([*x], np.uint64)
        text = np.array([sentence_pieces.xxhash.xxh64_intdigest(word.encode(), 0)], np.uint64)
        key = sentence_pieces.mix(text ^ sentence_pieces.mix(number(variant) ^ sentence_pieces.seed_of(3)))
        cells = [[int(pieces.symbol_of[ord(c)]), i] for i, c in enumerate(word)]
        skipped = set()
        while True:
            pairs = [(a[0] * pieces.n + b[0], a[1], i) for i, (a, b) in enumerate(zip(cells, cells[1:]))]
            best = min(((offer[p][0], i, p, at) for p, at, i in pairs if p in offer and (at, p) not in skipped), default=None)
            if best is None:
                return [c for c, _ in cells]
            _, i, pair, at = best
            if int(sentence_pieces.mix(sentence_pieces.mix(key ^ number(pair)) ^ number(at))[0]) < bar:
                skipped.add((at, pair))
            else:
                cells[i : i + 2] = [[offer[pair][1], at]]

    words = [" hello", " unbelievable", " thanonnt", " aaaaaaa"]
    for variant in range(4):
        made = pieces.segment(words, [variant] * len(words), 0.3, 3)
        assert [np.frombuffer(x, "<i4").tolist() for x in made] == [plain(w, variant) for w in words]


def test_every_occurrence_of_a_word_draws_its_own_cuts():
    """Neither the occurrences in a document nor the documents share a few segmentations."""
    pieces = sentence_pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    cut = sentence_pieces.encoder(pieces, 0.4, 7)
    word = "internationalization"
    texts = [word, " ".join([word] * 300)]
    one = {tuple(cut([word], [d])[0].tolist()) for d in range(300)}
    assert len(one) > 20
    starts = lambda ids: [k for k, i in enumerate(ids) if pieces.bytes_of[i][:1] == b" "] + [len(ids)]
    many = cut(texts, [5, 6])[1].tolist()
    assert len({tuple(many[a:b]) for a, b in zip(starts(many), starts(many)[1:])}) > 20
    # the same whatever stands in the batch
    assert many == cut(texts[1:], [6])[0].tolist() != cut(texts[1:], [-6])[0].tolist()


def test_repeated_words_are_not_cut_anew(monkeypatch):
    """Words that were seen before walk through remembered states and are cut as the agenda cuts them, also after those were forgotten."""
    pieces = sentence_pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(8)
    some = ["hello", "unbelievable", "x", "漢字😀", "é" * 19, "▁▁", "internationalization", "z" * 60, "aaaaaaa", "a\nb"]
    texts = [" ".join(rng.choices([*some, f"once{rng.random()}"], k=400)) for _ in range(12)]
    whole = pieces.segments
    numbers = [5, -6, *range(10)]
    of_doc = sentence_pieces.mix(np.array([x % 2**64 for x in numbers], np.uint64) ^ sentence_pieces.seed_of(7, 1))
    for most in (10**6, 100):
        monkeypatch.setattr(sentence_pieces, "_STATES", {})
        monkeypatch.setattr(sentence_pieces, "MOST_STATES", most)
        monkeypatch.setattr(sentence_pieces, "CUT_CHARS", 10_000)
        for dropout in (0.1, 0.5, 1.0):
            handed = []
            pieces.segments = lambda words, *rest: handed.extend(words) or whole(words, *rest)
            made = sentence_pieces.encoder(pieces, dropout, 7)(texts, numbers)
            assert not {w for w in handed if w in {" hello", " unbelievable", " x", " aaaaaaa"}} and " " + "z" * 60 in handed
            for text, doc, got in zip(texts, of_doc, made, strict=True):
                words = sentence_pieces.WORD.findall(" " + text)
                variants = sentence_pieces.mix(doc ^ np.arange(len(words)).astype(np.uint64))
                assert got.tolist() == whole(words, variants, dropout, 7)[0].tolist()
                assert pieces.joined(got) == (" " + text).encode()


# ---- secrets ---------------------------------------------------------------------------------------------------------

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found, key=lambda x: (x[0], ["assign", "access", "hex"].index(x[2])))


def test_secrets_equal_the_patterns(spark, odd):
    rng = random.Random(3)
    parts = ["token", "Secret", "api_key", "APIKEY", '"', "'", " ", ":", "=", "abc", "AKIA", "AKIAABCDEFGH1234", "0123456789abcdef", "é", "漢", "\n", "-", ".", "ſecret"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 16))) for _ in range(3000)]
    df = docs_of(spark, list(enumerate(texts))).unionByName(odd.withColumn("doc_id", F.col("doc_id") + 10_000))
    given = {r.doc_id: r.text or "" for r in df.collect()}
    for r in secret_scan.digest(secret_scan.find_secrets(df)).collect():
        want = base_spans(given[r.doc_id])
        kinds = collections.Counter(k for _, _, k in want)
        assert (r.n_assign, r.n_access, r.n_hex) == (kinds["assign"], kinds["access"], kinds["hex"])
        text = ",".join(f"{k}:{b}:{e}" for b, e, k in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))


def test_added_kinds_and_redaction():
    scan = secret_scan.scanner(secret_scan.RULES)
    text = "x ghp_" + "a1B2" * 10 + " é -----BEGIN RSA PRIVATE KEY----- xoxb-1234567890-abcdefgh"
    found = secret_scan.spans_of(text, scan)
    assert [secret_scan.RULES[k].kind for *_, k in found] == ["forge", "private_key", "chat"]
    assert secret_scan.redact(text, [(b, e) for b, e, _ in found]) == "x [secret] é [secret] [secret]"


# ---- HTML ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("page", "text"), [
    ("<p>a<p>b", "a\n\nb"),
    ("<div>a</div><div>b</div>", "a\nb"),
    ("a  \n b<br>c", "a b\nc"),
    ("<ul><li>a<li>b</ul>", "- a\n- b"),
    ("<ol start=3><li>a<ul><li>x</ul><li>b</ol>", "3. a\n   - x\n4. b"),
    ("<table><tr><th>Name<th>n<tr><td>apple<td>10</table>", "Name  | n\napple | 10"),
    ("<script>var a='</p>'</script><style>p{}</style><p hidden>x</p><p style='display:none'>y</p>z", "z"),
    ("<pre>  a\n   b</pre>", "  a\n   b"),
    ("1 < 2 &lt;b&gt; &amp;amp;", "1 < 2 <b> &amp;"),
    ("<!-- no --><title>t</title><b>x</b>y<!-- open", "xy"),
    ("<select><option>a<option>b</select>", "a\nb"),
    ("", ""),
])
def test_visible_text(page, text):
    assert html_text.visible_text(page) == text


def test_pages_with_odd_rows(spark):
    rows = [(1, None, "t"), (2, "", "t"), (2, "", "t"), (None, "<p>x", "t"), (3, "<div>" * 3000 + "deep", "t"), (4, "<a " * 500, "t")]
    pages = spark.createDataFrame(rows, "page_id bigint, html string, text string")
    out = html_text.extract_text(pages).collect()
    assert collections.Counter((r.page_id, r.n_lines) for r in out if r.page_id != 4) == {(1, 0): 1, (2, 0): 2, (None, 1): 1, (3, 1): 1}
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_tags_of_any_length_and_number():
    data = "data:image/png;base64," + "iVBO>'Rw0<b" * 1000
    image = f'<img alt="pic" src="{data}">'
    page = "".join(f"<p>text {k} {image}</p><div title='{'x' * 9000}' style=\"display:none\">gone</div {'y' * 9000}>" for k in range(120))
    assert html_text.visible_text(page) == "\n\n".join(f"text {k} pic" for k in range(120))


def test_long_tags_equal_the_pattern():
    rng = random.Random(3)
    for _ in range(3000):
        page = "".join(rng.choices(["<", "a", "/", " ", "'", '"', ">", "="], [4, 6, 1, 2, 1, 1, 1, 1], k=rng.randrange(1, 60)))
        long_tags = html_text.LongTags(page)
        at = page.find("<")
        while at >= 0:
            m = html_text.TOKEN.match(page, at)
            found = long_tags.tag(at)
            assert found == (m and (m["end"], m["name"], m["rest"], m.end()))
            at = page.find("<", found[3] if found else at + 1)


def test_open_long_tags_cost_linear_time():
    began = time.perf_counter()
    for part in ("<a '", '<a "x" ', "<a", "<a b='\"' "):
        html_text.visible_text(part * (400_000 // len(part)))
    assert time.perf_counter() - began < 60


def test_spanned_rows_and_visible_parts():
    text = html_text.visible_text
    assert text("<table><tr><td rowspan=2>A<td>b1<tr><td>b2<tr><td>c<td>d</table>") == "A | b1\n  | b2\nc | d"
    assert text("<table><tr><td>x<td rowspan=3>A<td>b1<tr><td>y<td>b2<tr><td>z</table>") == "x | A | b1\ny |   | b2\nz |"
    assert text("<table><tr><td rowspan=9 colspan=2>A<td>b<tr><td>c</table>") == "A   | b\n    | c"
    assert text("<p style='visibility:hidden'>no <b style='visibility:visible'>yes</b> no</p><p>z</p>") == "yes\n\nz"
    assert text("<div style='visibility:hidden'>a<p>b<img alt=c></p></div><p aria-hidden=true>seen</p>") == "seen"
    assert text("<div style='display:none'><b style='visibility:visible'>no</b></div>x") == "x"


# ---- line chunks -----------------------------------------------------------------------------------------------------


def sentences(rng, n):
    return [" ".join(f"w{rng.randrange(10**6)}" for _ in range(9)) + "." for _ in range(n)]


def test_lines_are_the_text():
    cuts = line_chunks.WordCuts()
    long = " ".join(f"w{k}" for k in range(60))
    for text in ("", "a", "a. b! c\n\nd...e\n", "\n\n", "no end", "x? y", " \n a", "a,  b;c", long, f"  {long}   {long} ", "x" * 500 + "  y"):
        lines = line_chunks.lines_of(text, cuts)
        assert "".join(lines) == text and lines == line_by_line(text)
        assert len(lines) < 2 or all(x.strip() for x in lines)
    assert len(line_chunks.lines_of(long, cuts)) > 5


# The rule once more without Spark or anything of the module: lines, chunks, growth, stretches and sizes are worked out anew.
ALL_BITS = 2**64 - 1


def scramble(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & ALL_BITS
    x = (x ^ x >> 27) * 0x94D049BB133111EB & ALL_BITS
    return x ^ x >> 31


def line_by_line(text):
    """The lines of a text, letter by letter."""
    raw, line, i = [], "", 0
    marks = ".!?,;:。！？，；：、"
    while i < len(text):
        c = text[i]
        line, i = line + c, i + 1
        if c in marks:
            while i < len(text) and text[i] in marks:
                line, i = line + text[i], i + 1
            if i < len(text) and text[i].isspace():
                line, i = line + text[i], i + 1
        elif c != "\n":
            continue
        raw.append(line)
        line = ""
    fine = []
    for x in raw + [line] * bool(line):
        if len(x) > 60:
            held, word = "", ""
            for k, c in enumerate(x):
                held, word = held + c, word if c == " " else word + c
                if word and (c == " " or k + 1 == len(x)):
                    if xxhash.xxh64_intdigest(word) % 4 == 0:
                        fine.append(held)
                        held = ""
                    word = ""
            x = held
        if x:
            fine.append(x)
    out = []
    for x in fine:
        if out and (not x.strip() or not out[-1].strip()):
            out[-1] += x
        else:
            out.append(x)
    return out


def plain_dedup(rows):
    """The rule of the operator without Spark, worked out anew: text, lines and words that went of each document."""
    lines = {d: [x.strip() for x in line_by_line(t)] for d, t in rows}
    lines = {d: x for d, x in lines.items() if x and x != [""]}
    chunks = collections.defaultdict(list)
    cut = {}
    for d, x in lines.items():
        h = [xxhash.xxh64_intdigest(y) for y in x]
        start, cut[d] = 0, []
        for i in range(len(x)):
            roll = scramble(h[i - 1] if i else 0)
            roll = scramble(roll * 0x100000001B3 & ALL_BITS ^ h[i])
            if (roll < int(0.65 * 2**64) and i > start) or i + 1 == len(x) or i + 1 - start == 16:
                cut[d].append((start, i + 1))
                chunks["\n".join(x[start : i + 1])].append((d, start, i + 1, len(cut[d]) - 1))
                start = i + 1
    gone = collections.defaultdict(set)
    for places in chunks.values():
        d0, s0, e0, k0 = min(places)
        for d, s, e, k in places:
            if (d, s) == (d0, s0):
                continue
            gone[d] |= set(range(s, e))
            j = 1
            while s - j >= cut[d][max(0, k - 2)][0] and s0 - j >= cut[d0][max(0, k0 - 2)][0] and lines[d][s - j] == lines[d0][s0 - j]:
                gone[d].add(s - j)
                j += 1
            j = 0
            while e + j < cut[d][min(len(cut[d]) - 1, k + 1)][1] and e0 + j < cut[d0][min(len(cut[d0]) - 1, k0 + 1)][1] and lines[d][e + j] == lines[d0][e0 + j]:
                gone[d].add(e + j)
                j += 1
    out = {}
    for d, t in rows:
        kept, went, words, run = [], 0, 0, []
        for n, x in [*enumerate(line_by_line(t)), (-1, "")]:
            if n in gone[d]:
                run.append(x)
                continue
            size = sum(len(y.split()) for y in run)
            if len(run) >= 2 and size >= 16:
                went, words = went + len(run), words + size
            else:
                kept += run
            run = []
            kept.append(x)
        out[d] = ("".join("".join(kept).split()), went, words)
    return out


def test_repeated_passages_go_and_the_first_stays(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(sentences(rng, 12))) for i in range(40)]
    passage = " ".join(sentences(rng, 10))
    for i in range(5, 30, 5):  # pasted behind half a sentence
        rows[i] = (i, rows[i][1][:101] + " " + passage + " " + rows[i][1][101:])
    rows += [(50, rows[7][1]), (51, "short. text."), (52, "short. text.")]
    out = by_id(line_chunks.deduplicated(docs_of(spark, rows)))
    assert {i: ("".join(r.text.split()), r.lines_removed, r.words_removed) for i, r in out.items()} == plain_dedup(rows)
    inner = ". ".join(passage.split(". ")[1:9])
    assert [i for i, r in out.items() if inner in r.text] == [5]
    assert all(out[i].words_removed >= 80 for i in range(10, 30, 5))
    assert out[50].text.strip() == "" and out[7].text == dict(rows)[7]
    assert all(out[i].text == t for i, t in rows if i < 40 and (i % 5 or i in (0, 5, 30, 35)))
    assert out[52].text == "short. text."


def test_passages_of_over_fifty_words_go_whatever_stands_around_them():
    """Six whole sentences, and one long sentence, as lines of their own or in the middle of a line, in many hosts."""
    rng = random.Random(10)
    removed = collections.defaultdict(list)
    for k in range(400):
        passage = " ".join(sentences(rng, 6)) if k % 2 else " ".join(f"w{rng.randrange(10**6)}" for _ in range(54)) + "."
        rows = []
        for d in range(2):
            host = " ".join(sentences(rng, 8)).split(" ")
            at, gap = rng.randrange(len(host)), " " if k % 4 < 2 else "\n"
            rows.append((d, " ".join(host[:at]) + gap + passage + gap + " ".join(host[at:])))
        out = plain_dedup(rows)
        assert out[0][1:] == (0, 0) and out[1][2] <= 54
        removed[k % 4].append(out[1][2] / 54)
    for shares in removed.values():
        # by the chance that no chunk lies wholly inside: about 1 % of six sentences, fewer of many short lines
        assert sum(x == 0 for x in shares) <= 0.06 * len(shares) and sum(shares) / len(shares) > 0.8


def test_line_dedup_keeps_odd_rows(spark, odd):
    out = line_chunks.deduplicated(odd)
    assert collections.Counter((r.doc_id, r.text) for r in out.collect() if r.doc_id != 5) == collections.Counter(
        (r.doc_id, r.text) for r in odd.collect() if r.doc_id != 5)
    assert line_chunks.deduplicated(odd.limit(0)).count() == 0
    assert line_chunks.drop_repeated(odd).columns[:4] == odd.columns


def test_chunks_equal_a_plain_restatement(spark):
    """Lines from a small pool, so that chunks repeat inside documents, grow into each other and end at different lines."""
    rng = random.Random(31)
    pool = [" ".join(f"p{rng.randrange(60)}" for _ in range(rng.choice([2, 5, 9, 60]))) + rng.choice([".", "?!", "...", "\n", ","]) for _ in range(25)]
    story = [f"line {n} of a story that is told often" + rng.choice([".", ",", "\n"]) for n in range(60)]
    rows = []
    for k in range(120):
        lines = [rng.choice(pool) if rng.random() < 0.5 else f"own{k}x{n} words here." for n in range(rng.randrange(0, 14))]
        if k % 3 == 0:
            at = rng.randrange(40)
            lines += story[at : at + rng.randrange(3, 20)]
        rows.append((k, "".join(x + rng.choice(["", " ", "\n\n", "  \n"]) for x in lines)))
    want = plain_dedup(rows)
    out = by_id(line_chunks.deduplicated(docs_of(spark, rows)))
    assert {k: ("".join(r.text.split()), r.lines_removed, r.words_removed) for k, r in out.items()} == want
    assert sum(w[1] for w in want.values()) > 50


def test_lines_with_clashing_names(spark):
    same = " ".join(f"Sentence {n} has several words in it." for n in range(6))
    df = spark.createDataFrame([(1, same, 5, 6, "a"), (2, "Own words. " + same, 7, 8, "b")], "doc_id bigint, text string, __doc int, doc int, chunk string")
    out = line_chunks.drop_repeated(df)
    assert out.columns == [*df.columns, "__lines", "__words"]
    assert sorted((r["doc_id"], r["__doc"], r["doc"], r["chunk"], r["__lines"]) for r in out.collect()) == [(1, 5, 6, "a", 0), (2, 7, 8, "b", 6)]


def test_lines_of_many_texts_at_once():
    """White space and marks of one to three bytes, at the ends of texts too, long runs of white space, null and empty texts."""
    rng = random.Random(12)
    alphabet = [*"ab .\n!?,;:\t。！？\u3000\u2003\xa0\x85\u2028é中😀\x1c", *["word "] * 9, *["中文 "] * 3, " " * 9]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 2, 3, 10, 100, 300]))) for _ in range(600)] + [None, "", "x"]
    lines = line_chunks.Lines(pa.array(texts)[1:], line_chunks.WordCuts())
    held, want = lines.data.tobytes(), [line_by_line(x or "") for x in texts[1:]]
    assert lines.sizes.tolist() == [len(x) for x in want]
    assert [held[x:y].decode() for x, y in zip(lines.begin.tolist(), lines.end.tolist())] == [y for x in want for y in x]
    assert lines.words().tolist() == [len(y.split()) for x in want for y in x]
    begin, end, sizes = lines.stripped()
    stripped = [[y.strip() for y in x if y.strip()] for x in want]
    assert sizes.tolist() == [len(x) for x in stripped]
    assert [held[x:y].decode() for x, y in zip(begin.tolist(), end.tolist())] == [y for x in stripped for y in x]
    assert line_chunks.hashes_of(lines.data, begin, end).tolist() == [xxhash.xxh64_intdigest(y) for x in stripped for y in x]
    assert lines.put_together(begin, end).decode() == "".join(y + "\n" for x in stripped for y in x)


def test_a_very_common_chunk_goes_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(line_chunks, "OFTEN", 20)
    rng = random.Random(13)
    same = [" ".join(f"Sentence {n} of part {k} has several words in it." for n in range(6)) for k in range(3)]
    rows = [(k - 90, " ".join([*sentences(rng, 5), same[k % 3], same[k % 2], *sentences(rng, 3), same[k % 3]])) for k in range(180)]
    docs = docs_of(spark, rows)
    base = docs.selectExpr("doc_id AS __id", "text AS __text")
    repeated = line_chunks.chunk_rows(base).groupBy("h").agg(F.min("doc").alias("least"), F.count("*").alias("n")).where("n > 1")
    likely = line_chunks.chunk_rows(base, line_chunks.may_repeat(repeated)).join(repeated, "h")
    shares = likely.where("n >= 100").groupBy("h").agg(
        F.countDistinct("share").alias("shares"), F.min("least").alias("least"), F.countDistinct(F.when(F.col("doc") == F.col("least"), F.col("share"))).alias("first")).collect()
    assert shares and all(r.shares == r.first == line_chunks.SHARES for r in shares)
    out = by_id(line_chunks.deduplicated(docs))
    assert {k: ("".join(r.text.split()), r.lines_removed, r.words_removed) for k, r in out.items()} == plain_dedup(rows)


# ---- MinHash ---------------------------------------------------------------------------------------------------------


def test_probability_jaccard_follows_its_definition():
    rng, hashes = random.Random(1), minhash.WordHashes()
    for _ in range(60):
        x, y = (minhash.weighted(" ".join(rng.choices("abc", k=k)), hashes) for k in (30, 25))
        a, b = (dict(zip(s.tolist(), n.tolist())) for s, n in (x, y))
        every = set(a) | set(b)
        want = sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in every) for d in set(a) & set(b))
        assert minhash.probability_jaccard(x, y) == pytest.approx(want)


def test_registers_estimate_probability_jaccard():
    rng, hashes = random.Random(2), minhash.WordHashes()
    errors = []
    for _ in range(30):
        words = [str(rng.randrange(200)) for _ in range(400)]
        other = words[: rng.randrange(200, 400)] + [str(rng.randrange(200)) for _ in range(60)]
        held = minhash.signatures_of(*minhash.counted([words, other], hashes), 2)
        true = minhash.probability_jaccard(*(minhash.weighted(" ".join(w), hashes) for w in (words, other)))
        errors.append((held[0] == held[1]).mean() - true)
    assert abs(np.mean(errors)) < 0.03 and np.max(np.abs(errors)) < 0.2


def test_classes_equal_brute_force(spark, odd):
    rng, hashes = random.Random(4), minhash.WordHashes()
    rows = []
    for g in range(30):
        words = [f"v{rng.randrange(4000)}" for _ in range(120)]
        for k in range(rng.randrange(1, 9)):
            copy = words[:]
            for _ in range(k):
                copy[rng.randrange(120)] = f"e{rng.randrange(9999)}"
            rows.append((len(rows) + 100, " ".join(copy)))
    rows.append((999, rows[0][1].upper().replace(" ", "\n")))
    df = docs_of(spark, rows).unionByName(odd)
    sets = {i: minhash.weighted(t, hashes) for i, t in rows}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and minhash.probability_jaccard(sets[i], sets[j]) >= 0.8:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    out = minhash.near_duplicates(df).collect()
    assert len(out) == df.count()
    got = {r.doc_id: r.class_id for r in out}
    assert {i: got[i] for i in sets} == {i: top(i) for i in sets}
    assert all(got[i] == i for i in (1, 2, 3, 4, 5, 6)) and all(r.kept == (r.class_id is None or r.class_id == r.doc_id) for r in out)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_rounds_see_all_ranks_when_the_main_component_changes(spark):
    """6 has five nearer neighbours than 9. In round one 9 is the main component; in round two 1 to 6 are, and 9 looks at 6 first."""
    registers, bands = minhash.REGISTERS, [7] + list(range(100, 99 + minhash.BANDS))
    held = {d: np.full(registers, 50 + d, "<u2") for d in (0, 9)}
    held |= {d: np.zeros(registers, "<u2") for d in range(1, 7)}
    far = int(0.2 * registers)
    held[9][far:] = 0  # agrees with 6 in 80 %, with the copies of 6 in less than the screen
    for d in range(1, 6):
        held[d][far : far + registers // 8] = 60 + d
    assert (held[9] == held[1]).mean() < minhash.SCREEN < (held[9] == held[6]).mean() < (held[1] == held[6]).mean()
    rows = [(d, 1, bytearray(x.tobytes()), bands) for d, x in held.items()]
    heads = spark.createDataFrame(rows, "doc bigint, cell bigint, registers binary, bands array<bigint>")
    buckets = spark.createDataFrame([(7, d) for d in held], "bucket bigint, doc bigint")
    joined = [[], [(d, 1) for d in range(1, 7)]]
    seen = set()
    for ranks, labels in zip(minhash.ROUNDS, joined):
        found = minhash.leftover_pairs(buckets, heads, spark.createDataFrame(labels, "node bigint, component bigint"), ranks)
        seen |= {tuple(p) for r in found.collect() for p in minhash.pairs_of([{"a": r.a, "b": r.b}]).tolist()}
    assert (6, 9) in seen


# ---- embeddings ------------------------------------------------------------------------------------------------------


def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CELL", 32)
    monkeypatch.setattr(embeddings, "BLOCK", 40)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 16))
    near = [base[rng.integers(8)] + 0.25 * rng.standard_normal(16) for _ in range(260)]
    rows = [(i, [float(x) for x in v], i) for i, v in enumerate([*base, *near, *[base[3]] * 9, 2 * base[4]])]
    n = len(rows)
    bad = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0]]
    rows += [(n + k, v, 0) for k, v in enumerate(bad)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, n_links int")
    exact = np.array([r.embedding for r in df.collect() if r.vec_id < n], float)
    exact /= np.linalg.norm(exact, axis=1)[:, None]
    linked = exact @ exact.T >= 0.9
    np.fill_diagonal(linked, False)
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], n).min(axis=1))
        if (new == label).all():
            break
        label = new
    out = by_id(embeddings.near_duplicates(df), "vec_id")
    assert len(out) == len(rows)
    recall = sum(out[i].n_links for i in range(n)) / linked.sum()
    assert recall >= 0.99 and all(out[i].n_links <= linked[i].sum() for i in range(n))
    assert np.mean([out[i].component_id == label[i] for i in range(n)]) >= 0.99
    assert all((out[n + k].n_links, out[n + k].component_id, out[n + k].kept) == (0, n + k, True) for k in range(len(bad)))
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize(("size", "power"), [(64, 0.5), (64, 1.0), (384, 1.0)])
def test_cells_of_anisotropic_partners_are_visited(size, power):
    """Partners that differ along the main directions of the data, as those of trained embeddings do."""
    rng = np.random.default_rng(9)
    spectrum = np.arange(1, size + 1) ** -power
    rows = embeddings.unit(rng.standard_normal((4000, size)) * spectrum)
    base = rows[:1500]
    aside = rng.standard_normal(base.shape) * spectrum
    aside = embeddings.unit(aside - (aside * base).sum(axis=1, keepdims=True) * base)
    partner = 0.901 * base + np.sqrt(1 - 0.901**2) * aside
    grid = embeddings.Grid(rows, 16)
    own, other = grid.cells(base), grid.cells(partner)
    one, two = own[0] * grid.size + own[1], other[0] * grid.size + other[1]
    there = {(int(i), int(c)) for row, cell in grid.visits(base, *own) for i, c in zip(row, cell)}
    back = {(int(i), int(c)) for row, cell in grid.visits(partner, *other) for i, c in zip(row, cell)}
    met = [((i, c) in there) + ((i, o) in back) for i, (o, c) in enumerate(zip(one.tolist(), two.tolist()))]
    apart = one != two
    assert np.mean(np.array(met) > 0) >= 0.95
    # of two cells only one visits the other
    assert max(np.array(met)[apart]) == 1
    assert len(there) <= 0.1 * len(base) * grid.size**2


def test_cells_are_taken_nearest_first():
    rows = embeddings.unit(np.random.default_rng(4).standard_normal((900, 12)))
    grid = embeddings.Grid(rows, 6)
    base = rows[:50]
    own = grid.cells(base)
    a, b = grid.least(base, *own)
    taken = {k: [] for k in range(len(base))}
    for row, i, j in grid.traverse(base, *own):
        for k, x, y in zip(row.tolist(), i.tolist(), j.tolist()):
            taken[k].append((a[k, x] + b[k, y], x, y))
    for k, found in taken.items():
        costs = [c for c, _, _ in found]
        assert costs == sorted(costs) and found[0][1:] == (own[0][k], own[1][k]) and len(set(found)) == len(found)
        want = {(x, y) for x in range(6) for y in range(6) if a[k, x] + b[k, y] <= grid.reach + embeddings.ROUNDING}
        assert {(x, y) for _, x, y in found} == want


def test_rows_that_share_an_id_are_linked_by_their_own_vectors(spark):
    rows = [(1, [1.0, 0, 0, 0]), (1, [0, 1.0, 0, 0]), (2, [0.99, 0.1, 0, 0]), (None, [0, 0, 1.0, 0]), (5, [0, 0, 1.0, 0.1]), (7, [0, 0, 1.0, 0])]
    df = spark.createDataFrame([(i, [float(x) for x in v], k) for k, (i, v) in enumerate(rows)], "vec_id bigint, embedding array<double>, rep int")
    out = sorted(((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in embeddings.near_duplicates(df).collect()))
    assert out == [(0, 2, 0, True), (1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False), (5, 2, 5, True), (7, 2, 5, False)]


# ---- decontamination -------------------------------------------------------------------------------------------------


def edits_within(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i in range(1, len(item) + 1):
            new.append(min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (item[i - 1] != c)))
        row, best = new, min(best, new[-1])
    return best


def test_edit_distance_equals_the_table():
    rng = random.Random(4)
    for _ in range(2000):
        item = [rng.randrange(3) for _ in range(rng.randrange(1, 9))]
        text = [rng.randrange(3) for _ in range(rng.randrange(0, 14))]
        most = rng.randrange(0, len(item))
        assert decontaminate.edit_distance_within(item, text, most) == (edits_within(item, text) <= most)


def test_items_are_found_within_their_edits(spark, odd):
    rng = random.Random(6)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    words = [w for _, t in items for w in t.split()]
    rows, want = [], {}
    for k, (item, text) in enumerate(items * 2):
        body = text.split()
        for _ in range(int(0.1 * len(body))):
            p = rng.randrange(len(body))
            body[p : p + 1] = rng.choice([["changed"], [], [body[p], "added"]])
        host = [rng.choice(words) for _ in range(80)]
        rows.append((k, " ".join(host[:40] + (body if k % 3 else []) + host[40:])))
        if k % 3:
            want[k] = item
    extra = spark.createDataFrame([(900, None), (901, ""), (902, "one"), (None, "x y z")], "item_id bigint, text string")
    df = docs_of(spark, rows).unionByName(odd.withColumn("doc_id", F.col("doc_id") + 5000))
    found = decontaminate.contaminated(df, bench.select("item_id", "text").unionByName(extra))
    out = by_id(found)
    hashes = decontaminate.WordHashes()
    plain = {i: decontaminate.symbols_of(t, hashes).tolist() for i, t in items}
    for k, text in rows:
        body = decontaminate.symbols_of(text, hashes).tolist()
        exact = sorted(i for i, s in plain.items() if edits_within(s, body) <= int(0.2 * len(s)))
        assert out[k].items == exact and (k not in want or want[k] in exact)
    assert all(r.n_items == 0 for i, r in out.items() if i is None or i > 5000)
    assert decontaminate.contaminated(df, bench.limit(0)).where("contaminated").count() == 0


@pytest.mark.parametrize("share", [0.15, 0.2])
def test_items_leaked_once_as_an_edited_copy_are_found(share):
    """No pair of an item stands in any other document, so the pairs that the edits broke are as rare as those they left."""
    rng = random.Random(8)
    rows = [(k, " ".join(f"i{k}w{rng.randrange(10**6)}" for _ in range(rng.randrange(10, 160)))) for k in range(300)]
    texts = []
    for _, text in rows:
        body = text.split()
        for n, p in enumerate(rng.sample(range(len(body)), int(share * len(body)))):
            body[p] = f"edit{n}"
        host = [f"h{rng.randrange(500)}" for _ in range(100)]
        texts.append(" ".join(host[:50] + body + host[50:]))
    found, walked = decontaminate.finder(decontaminate.Items(rows))(texts)
    assert found == [[k] for k, _ in rows]
    assert sum(map(len, walked)) >= 0.95 * len(rows) and all(set(w) <= set(f) for w, f in zip(walked, found))


def test_walks_of_other_texts_do_not_meet():
    """Walks write the symbols of a plain step-by-step walk, and unrelated items agree in no sample but by chance."""
    rng = random.Random(2)
    items = decontaminate.Items([(k, " ".join(f"w{rng.randrange(200)}" for _ in range(rng.randrange(20, 60)))) for k in range(200)])
    keys = items.keys
    met = [((keys[i] == keys[j]) & (keys[i] != 0)).any() for i in range(200) for j in range(i)]
    assert np.mean(met) < 0.01
    for k in (0, 7):
        for number in (0, 5):
            at, key, ended = 0, np.zeros(1, np.uint64), False
            wanted = items.places[k, number].tolist()
            for step in range(max(wanted) + 1):
                over = at >= items.sizes[k]
                symbol = np.array([0 if over else items.symbols[k][at]], np.uint64)
                if step in wanted:
                    key, ended = decontaminate.mix((key * np.uint64(0x100000001B3)) ^ symbol), ended or over
                bit = decontaminate.mix(symbol ^ decontaminate.mix(np.array([number], np.uint64) ^ decontaminate.seed_of(6, 2, step)))
                at += int(not over and bit[0] & np.uint64(1) == 1)
            assert keys[k, number] == (0 if ended else key[0])


# ---- URLs ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("url", "host", "path", "rule", "verdict"), [
    ("http://a.com/x?q", "a.com", "/x", "com/", "allow"),
    ("http://A.Example.com/en/1", "a.example.com", "/en/1", "example.com/en/", "block"),
    ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("https://x.www.example.com/en/", "x.www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("ftp://b.net/es/#x", "b.net", "/es/", "net/es/", "block"),
    ("http://b.net/es", "b.net", "/es", None, None),
    ("http://a.com", "a.com", "", None, None),
    ("http://notcom/", "notcom", "/", None, None),
    ("x://y://z.net/fr/", "y:", "//z.net/fr/", None, None),
    ("no scheme", "", "", None, None),
    (None, "", "", None, None),
])
def test_url_parts_and_rules(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(url,)], "url string")
    h, p = url_filter.url_parts(F.col("url"))
    r = df.select(h.alias("host"), p.alias("path")).withColumn("r", url_filter.rule_of(F.col("host"), F.col("path"))).first()
    assert (r.host, r.path) == (host, path)
    assert (r.r and (r.r.rule, r.r.verdict)) == (rule and (rule, verdict))


def test_best_split_is_the_most_probable():
    counts = {"cheap": 50, "pills": 40, "the": 500, "re": 300, "there": 200, "in": 900}
    assert url_filter.best_split("cheappills", counts, 2000) == ["cheap", "pills"]
    assert url_filter.best_split("there", counts, 2000) == ["there"]
    assert url_filter.best_split("", counts, 2000) == []
    assert "".join(url_filter.best_split("xqzthere", counts, 2000)) == "xqzthere"


def test_verdicts_equal_a_plain_bayes(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html")
    odd = spark.createDataFrame([(-1, None, None), (-2, "nothing", ""), (-3, "http:///p", "x"), (None, "http://q.org/en", "x")], pages.schema)
    rows = url_filter.url_verdicts(pages.unionByName(odd)).collect()
    assert len(rows) == pages.count() + 4
    taught = [r for r in rows if r.rule]
    count = {v: collections.Counter(w for r in taught if r.verdict == v for w in r.words) for v in ("allow", "block")}
    size = len(set(count["allow"]) | set(count["block"]))
    number = collections.Counter(r.verdict for r in taught)
    for r in rows:
        if r.rule is None:
            score = np.log((number["block"] + 1) / (number["allow"] + 1))
            for w in r.words:
                if w in count["allow"] or w in count["block"]:
                    score += np.log((count["block"][w] + 1) / (sum(count["block"].values()) + size + 1))
                    score -= np.log((count["allow"][w] + 1) / (sum(count["allow"].values()) + size + 1))
            assert abs(score) < 1e-9 or r.verdict == ("block" if score > 0 else "allow")


# ---- toxicity --------------------------------------------------------------------------------------------------------


def test_scoring_memory_is_bounded():
    """Many texts of words that occur once: a worker's memory stays small, and what it forgets and group sizes change no score."""
    rng = random.Random(14)
    texts = [" ".join(f"x{rng.randrange(10**9)}" for _ in range(rng.choice([0, 5, 40, 3000]))) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    network = toxicity.Network(["a", "b"])
    score = toxicity.scorer(network)
    tracemalloc.start()
    got = [x for part in groups(iter([batch]), "text", toxicity.SCORED_CHARS) for x in score(part.column(0).to_pylist())]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    network.forget()
    assert got[:40] == pytest.approx([toxicity.scorer(network)([x])[0] for x in texts[:40]], abs=1e-6)


def test_words_of_many_texts_at_once():
    every = "".join(chr(c) + " a"[c % 3 == 0] for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for texts in ([], [""], ["", " ", "\n"], ["a", "a b\nA", "", "ΑΣ", "Σ", "İx ß_1 漢字😀é"], [every, *strange_texts(200)]):
        words, row, sizes = toxicity.split_words(texts)
        want = [toxicity.words_of(x) for x in texts]
        assert [words[i] for i in row.tolist()] == [w for x in want for w in x] and len(set(words)) == len(words)
        assert sizes.tolist() == [len(x) for x in want] == [toxicity.n_words(x) for x in texts]


def test_scores_equal_those_of_single_windows():
    """Scoring reads each word's inputs once for both windows that it lies in; scores are those of the windows one by one."""
    rng = random.Random(3)
    sizes = [0, 1, 31, 32, 33, 47, 48, 49, 63, 64, 65, 80, 500, *(rng.randrange(300) for _ in range(60))]
    texts = [" ".join(rng.choice("ab cd efgh ijk lmnop q12 ß".split()) + str(rng.randrange(50)) for _ in range(n)) for n in sizes]
    network = toxicity.Network(["ab1", "cd2"])
    network.w["out"] *= 20
    want = []
    for text in texts:
        words = toxicity.words_of(text)
        logits = []
        for at in toxicity.window_rows(len(words)):
            part = words[at : at + toxicity.WINDOW]
            gates = np.zeros((toxicity.WINDOW, 1, 6 * toxicity.HIDDEN), np.float32)
            if part:
                gates[: len(part), 0] = network.inputs(part)[0] @ network.w["in"] + network.w["in0"]
            logits.append(network.logits(gates, (np.arange(toxicity.WINDOW) < len(part)).astype(np.float32)[:, None])[0])
        want.append(toxicity.sigmoid(float(max(logits))))
    assert toxicity.scorer(network)(texts) == pytest.approx(want, abs=1e-5) and np.std(want) > 1e-3
    rows = []
    halves = network.halves

    class Counted(np.ndarray):
        def take(self, at, *rest, **named):
            rows.append(np.size(at))
            return np.asarray(self).take(at, *rest, **named)

    network.halves = lambda table: [x.view(Counted) for x in halves(table)] if len(table) != toxicity.HIDDEN else halves(table)
    toxicity.scorer(network)([" ".join(texts[12:13] * 20)])
    assert sum(rows) < 2.1 * 500 * 20  # twice a word, for the two directions, where windows hold each word twice for both


def toxic_texts(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(rng.choices("abcdeghilmnorstu", k=rng.randrange(2, 9))) for _ in range(rng.randrange(5, 150))]
        bad = i % 4 == 0
        for _ in range(3 * bad):
            words.insert(rng.randrange(len(words)), "vex" + "".join(rng.choices("abcd", k=4)))
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_toxicity_learns_from_its_folds_only(spark, odd):
    rows = toxic_texts(1200, 1)
    docs = docs_of(spark, [(i, t) for i, t, _ in rows])
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    flipped = spark.createDataFrame([(i, 1 - y if i in held else y) for i, _, y in rows], "doc_id bigint, toxic int")
    out = toxicity.toxicity(docs.unionByName(odd.withColumn("doc_id", F.col("doc_id") + 5000)), labels).collect()
    assert {r.doc_id for r in out if r.held_out and r.doc_id < 5000} == held
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out) and len(out) == 1200 + odd.count()
    truth = {i: y for i, _, y in rows}
    right = [r.predicted == truth[r.doc_id] for r in out if r.held_out and r.doc_id is not None and r.doc_id < 5000]
    assert np.mean(right) > 0.9
    again = {r.doc_id: r.score for r in toxicity.toxicity(docs, flipped).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score, abs=1e-6) for r in out if r.doc_id is not None and r.doc_id < 5000)


def test_toxicity_without_labels_is_constant(spark, odd):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxicity.toxicity(odd, none).select("score").distinct().count() == 1


def test_gradient_equals_differences():
    network = toxicity.Network(["a", "b"])
    for k in network.w:
        network.w[k] = network.w[k].astype(np.float64)
    rng = np.random.default_rng(0)
    gates = rng.standard_normal((5, 3, 6 * toxicity.HIDDEN))
    mask = np.array([[1, 1, 1], [1, 1, 0], [1, 1, 0], [1, 0, 0], [1, 0, 0]], float)
    target = np.array([1.0, 0.0, 1.0])

    def loss():
        p = toxicity.sigmoid(network.logits(gates, mask))
        return -(target * np.log(p) + (1 - target) * np.log(1 - p)).mean()

    g, by_gates = network.gradient(gates, mask, target)
    for array, slope in [(gates, by_gates), *((network.w[k], g[k]) for k in ("back", "look", "look0", "pick", "out", "out0"))]:
        for at in [tuple(rng.integers(0, n) for n in array.shape) for _ in range(6)]:
            old = array[at]
            array[at] = old + 1e-5
            high = loss()
            array[at] = old - 1e-5
            low = loss()
            array[at] = old
            assert slope[at] == pytest.approx((high - low) / 2e-5, abs=2e-4)


def test_toxicity_learns_from_every_labelled_text(spark, monkeypatch):
    """What documents beyond the sample for the first weights say changes words, weights and bias."""
    monkeypatch.setattr(toxicity, "MOST_TOXIC", 30)
    monkeypatch.setattr(toxicity, "MOST_CLEAN", 60)
    rows = toxic_texts(800, 2)
    docs = docs_of(spark, [(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    used = labels.where("crc32(cast(cast(doc_id AS string) AS binary)) % 4 <> 2").withColumn("place", F.xxhash64(F.lit(toxicity.SEED), "doc_id"))
    used = [(r.doc_id, r.toxic) for r in used.orderBy("place").collect()]
    first = {i for y in (0, 1) for i in [i for i, z in used if z == y][: 200]}
    changed = docs_of(spark, [(i, t if i in first else t + " outermost") for i, t, _ in rows])
    one, other = toxicity.fit(docs, labels), toxicity.fit(changed, labels)
    assert "outermost" in other.number and "outermost" not in one.number
    assert not np.array_equal(one.w["out"], other.w["out"])
    again = toxicity.fit(docs, labels)
    assert all(np.array_equal(one.w[k], again.w[k]) for k in one.w)
