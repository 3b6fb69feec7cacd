"""Pipeline operators against the libraries and against brute force, with odd rows."""

import collections
import hashlib
import html
import re
import struct
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerloom.llm import bpe, byte_chunks, decontaminate, html_text, jaccard_join, language_id, line_dedup, quality_model, quality_rules, token_counts, token_store
from ledgerloom.llm.pretokens import BYTE_PATTERN, UNCOMMON, WORD_PATTERN

SF = "/root/testdata/sf0.001"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = " ".join(f"word{i}" for i in range(80))
ODD = [
    None, "", " ", "\n\n", "One", "<|endoftext|>a<|endoftext|>", "ΑΣ Σ odd ς 日本語 　 x", "aaa aaaa aaaaaaa!!!! '' 's I'll", "İstanbul é ́",
    "\x1c \x85  tab\t\n  x  ", "😀 <|startoftext|> <|x", "a" * 3000, WORDS, WORDS, WORDS.replace("word40", "other"), "the cat sat " * 60,
    "page number 1 of the great book\nshort\npage number 2 of the great book", "page number 1 of the grea book", " end.", "a.b,c...d ,e",
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, one row twice, a null id, and extra columns named like results and inner columns."""
    rows = [(i, t, "en", "src", 7, "x") for i, t in enumerate(ODD)] + [(12, WORDS, "en", None, 7, "x"), (None, WORDS, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens int, spans string").cache()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_split_patterns_agree_with_the_library_on_common_characters():
    import unicodedata

    import regex

    byte, word = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    find_byte, find_word = regex.compile(BYTE_PATTERN).findall, regex.compile(WORD_PATTERN).findall
    for point in range(0x2200):
        if UNCOMMON.search(chr(point)):
            continue
        for text in (f"a{chr(point)}b", f" {chr(point)} 1", f"{chr(point)}{chr(point)}. a"):
            assert find_byte(text) == [text[a:b] for _, (a, b) in byte.pre_tokenizer.pre_tokenize_str(text)]
            assert unicodedata.normalize("NFC", re.sub(r"\s+", " ", text)).lower() == word.normalizer.normalize_str(text) or re.search(r"[\x1c-\x1f]", text)
            normal = word.normalizer.normalize_str(text)
            pieces = [normal[a:b] for _, (a, b) in word.pre_tokenizer.pre_tokenize_str(normal)]
            assert find_word(unicodedata.normalize("NFC", text).lower()) == pieces


def test_token_counts_equal_the_library(odd, docs):
    library = Tokenizer.from_file(BYTE)
    for df in (odd, docs):
        texts = {r["doc_id"]: r["text"] or "" for r in rows_of(df)}
        got = rows_of(token_counts.token_counts(df, BYTE))
        assert len(got) == df.count()
        for r in got:
            n = len(library.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
            assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(texts[r["doc_id"]].encode()), n > 512)
    assert rows_of(token_counts.token_counts(odd.limit(0), BYTE)) == []


def test_bpe_ids_and_decoding_equal_the_library(odd, docs):
    library = Tokenizer.from_file(WORD)
    for df in (odd, docs):
        texts = {r["doc_id"]: r["text"] or "" for r in rows_of(df)}
        got = rows_of(bpe.decode(bpe.encode(df, WORD), WORD))
        assert len(got) == df.count()
        for r in got:
            ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
            assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == ids
            assert r["text"] == library.decode(ids, skip_special_tokens=False)


def test_token_store_reads_back_what_it_wrote(spark, odd, docs, tmp_path):
    library = Tokenizer.from_file(BYTE)
    df = docs.select("doc_id", "text").unionByName(odd.where("doc_id is not null").selectExpr("doc_id + 1000000 as doc_id", "text"))
    rows, start = sorted(((r["doc_id"], r["text"] or "") for r in rows_of(df)), key=lambda r: (r[0], r[1])), 0
    path = str(tmp_path / "store")
    token_store.write_store(df, path, BYTE)
    got = sorted(rows_of(token_store.layout(spark, path)), key=lambda r: r["start"])
    assert len(got) == len(rows)
    for (doc_id, text), r in zip(rows, got, strict=True):
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    assert token_store.read_document(spark, path, rows[5][0])[0][:-1] == library.encode(rows[5][1], add_special_tokens=False).ids
    empty = str(tmp_path / "empty")
    token_store.write_store(df.limit(0), empty, BYTE)
    assert rows_of(token_store.layout(spark, empty)) == []


def rule_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_match_brute_force(odd, docs):
    for df in (odd, docs):
        got = rows_of(quality_rules.quality_rules(df))
        assert len(got) == df.count()
        for r in got:
            want = rule_counts(r["text"])
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
            assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
            assert not (r["kept"] and r["base_failed"])
    assert rows_of(quality_rules.quality_rules(odd.limit(0))) == []


def test_a_bad_host_loses_its_documents_and_a_small_one_does_not(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good if i % 10 else "short", "fine") for i in range(200)] + [(500 + i, "short" if i else good, "bad") for i in range(100)] + [(900, "short", "one"), (901, good, "one")]
    got = {r["doc_id"]: r for r in rows_of(quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")))}
    assert got[1]["kept"] and got[901]["kept"] and not got[500]["kept"] and got[500]["host_rejected"]


def document_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def test_decontamination_matches_brute_force(spark, odd, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").unionByName(
        spark.createDataFrame([(900, "The of"), (901, "CAT"), (902, None), (903, ""), (904, " ".join(f"word{i}" for i in range(5, 30)))], "item_id long, text string")
    )
    windows = collections.defaultdict(set)
    for r in rows_of(bench):
        words = document_words(r["text"])
        n = min(10, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows[tuple(words[i : i + n])].add(str(r["item_id"]))
    for df in (odd, docs):
        texts = {r["doc_id"]: r["text"] for r in rows_of(df)}
        got = rows_of(decontaminate.report(decontaminate.decontaminate(df, bench)))
        assert len(got) == df.count()
        for r in got:
            words, hit, items = document_words(texts[r["doc_id"]]), set(), set()
            for n in {len(w) for w in windows}:
                for i in range(len(words) - n + 1):
                    if found := windows.get(tuple(words[i : i + n])):
                        hit.update(range(i, i + n))
                        items |= found
            want = (len(words), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit))
            assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == want
    assert not any(r["contaminated"] for r in rows_of(decontaminate.decontaminate(docs, bench.limit(0))))


def within_one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def test_line_dedup_matches_brute_force(odd):
    got = rows_of(line_dedup.line_dedup(odd))
    lines = sorted({((r["doc_id"], i), x) for r in rows_of(odd) if r["doc_id"] is not None for i, x in enumerate((r["text"] or "").split("\n")) if len(x) >= line_dedup.MIN_CHARS})
    for r in got:
        text = ODD[r["doc_id"]] if r["doc_id"] is not None else WORDS
        keep = [x for i, x in enumerate((text or "").split("\n")) if len(x) < line_dedup.MIN_CHARS or r["doc_id"] is None or not any(o < (r["doc_id"], i) and within_one_edit(x, y) for o, y in lines)]
        assert r["text"] == (None if text is None else "\n".join(keep))
    assert len(got) == odd.count()
    assert rows_of(line_dedup.line_dedup(odd.limit(0))) == []


def test_line_dedup_finds_edits_within_runs_of_equal_characters(spark):
    """Double letters and digits: a substitution inside a run meets its partner, whichever of the two is earlier."""
    base = ["the committee agreed on the plan", "a line with the number 100 in it", "a line with the number 11 in it", "aaaaaaaaaaaaaaaaaaaaaaaa", "good books are read twice"]
    lines = base + ["the comnittee agreed on the plan", "a line with the number 101 in it", "a line with the number 12 in it", "gord books are read twice"]
    lines += ["a" * i + "b" + "a" * (23 - i) for i in (0, 5, 11, 12, 23)] + ["a" * 25, "b" + "a" * 23 + "b", "the comittee agreed on the plan", "the commmittee agreed on the plam"]
    rng = np.random.default_rng(3)
    lines += ["".join("ab"[x] for x in rng.integers(0, 2, n)) for n in rng.integers(20, 22, 400).tolist()]
    for order in (lines, lines[::-1]):
        docs = spark.createDataFrame(list(enumerate(order)), "doc_id long, text string")
        got = {r["doc_id"]: r["n_removed"] for r in rows_of(line_dedup.line_dedup(docs))}
        assert got == {i: int(any(within_one_edit(x, y) for y in order[:i])) for i, x in enumerate(order)}


def test_short_lines_go_with_an_equal_earlier_line_only(spark):
    """Exact copies of short lines with a word go; one edit is not enough, and marks and empty lines stay."""
    texts = ["Read more\n--\n\nBook 1\n4", "Read more\n--\n\nBook 2\n4\nread more", "Überschrift\n日本\n ", "日本\n \nÜberschrift\nRead more \nBook 1\nBook 1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in rows_of(line_dedup.line_dedup(docs))}
    assert got == {0: (texts[0], 0), 1: ("--\n\nBook 2\nread more", 2), 2: (texts[2], 0), 3: (" \nRead more ", 4)}


def brute_components(texts):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets, parent = {d: shingles(t) for d, t in texts.items()}, {d: d for d in texts}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= 80 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_jaccard_components_match_brute_force(odd, docs):
    for df in (odd.where("doc_id is not null"), docs):
        want = brute_components({r["doc_id"]: r["text"] for r in rows_of(df)})
        got = rows_of(jaccard_join.jaccard_join(df))
        assert len(got) == df.count()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert rows_of(jaccard_join.jaccard_join(odd.limit(0))) == []


def test_links_beyond_the_first_of_a_block_are_found(spark):
    """A chain of texts, each near the next only, and a tree join against all pairs."""
    words = [f"v{i}" for i in range(140)]
    texts = {k: " ".join(words[3 * k : 3 * k + 100]) for k in range(12)}
    got = {r["doc_id"]: r["component_id"] for r in rows_of(jaccard_join.jaccard_join(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))}
    assert got == {d: c for d, (_, c) in brute_components(texts).items()}
    rng = np.random.default_rng(1)
    counts, sizes = rng.poisson(0.5, (300, jaccard_join.GROUPS)), np.zeros(300, np.int64)
    counts[150:] = counts[:150] + (rng.random((150, jaccard_join.GROUPS)) < 0.02)
    sizes = counts.sum(axis=1)
    tree = jaccard_join.Tree(counts, sizes)
    pairs = set(zip(*(x.tolist() for x in tree.join(tree)), strict=True))
    n, m = sizes[:, None], sizes[None, :]
    bound = (np.minimum(counts[:, None], counts[None]).sum(axis=2) >= jaccard_join.needed(n, m)) & (100 * n >= 80 * m) & (100 * m >= 80 * n)
    assert pairs == set(zip(*(x.tolist() for x in np.nonzero(bound)), strict=True))


def test_html_main_text(spark):
    rows = [
        (1, "http://a.b/1", "<nav><li>m</li></nav><header>h</header><article><h1>T &amp; x</h1><p>one\n two<br>three<p>four</article><footer>f</footer>"),
        (2, "http://a.b/2", "<article><p>x &lt; y</p><div class='comments'>no</div><script>if (a<b) '</p>'</script></article>"),
        (3, None, None), (4, "x", ""), (4, "x", ""),
        (5, "http://q/", "<div class=cookie-notice>c</div><p>first own words here</p><p>a b c d e f g h i j</p>"),
        (6, "http://q/2", "<p>second own words there</p><p>a b c d e f g h i j</p>"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r["page_id"], r["text"]) for r in rows_of(html_text.extract(pages)))
    assert got == [(1, "T & x\none two three\nfour"), (2, "x < y"), (3, ""), (4, ""), (4, ""), (5, "first own words here"), (6, "second own words there")]
    assert rows_of(html_text.extract(pages.limit(0))) == []
    real = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in rows_of(html_text.extract(real))}
    for r in rows_of(real):
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?(b|br)>", " ", x)).split()) for x in re.split(r"</?(?:h1|p)>", inner)]
        assert got[r["page_id"]] == "\n".join(b for b in blocks if b)


def test_html_runs_on_two_pages_of_a_large_host_are_found(spark, monkeypatch):
    """However many buckets a host has; versions of one page are no evidence against each other."""
    monkeypatch.setattr(html_text, "BUCKET_PAGES", 2)
    words = lambda name: " ".join(f"{name}w{j}" for j in range(12))
    rows = [(i, f"http://large.x/{i}", f"<p>{words(f'own{i}')}</p><div>{words(f'pair{i // 2}')}</div>") for i in range(120)]
    rows += [(500, "http://large.x/500", f"<p>{words('twin')}</p>")] * 2 + [(501, "http://other.x/", f"<p>{words('pair3')}</p>")]
    got = {(r["page_id"], r["text"]) for r in rows_of(html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")))}
    assert got == {(i, words(f"own{i}")) for i in range(120)} | {(500, words("twin")), (501, words("pair3"))}


def test_html_blocks_beside_an_article_are_evidence(spark):
    """An open or marked block on pages with an article or main element also goes from a page without; articles stay."""
    menu, notice, body = (" ".join(f"{name}{j}" for j in range(10)) for name in ("menu", "notice", "body"))
    rows = [
        (1, "http://a.b/1", f"<div>{menu}</div><article><p>{body}</p></article>"),
        (2, "http://a.b/2", f"<main><p>{body} two</p></main><div class='notice'>{notice}</div>"),
        (3, "http://a.b/3", f"<div>{menu}</div><p>only here are these words seen</p><div>{notice}</div><p>{body}</p>"),
        (4, "http://c.d/3", f"<div>{menu}</div>"),
    ]
    got = {r["page_id"]: r["text"] for r in rows_of(html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")))}
    assert got == {1: body, 2: f"{body} two", 3: f"only here are these words seen\n{body}", 4: menu}


def test_quality_scores_on_held_out_rows(spark, odd):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = rows_of(quality_model.quality_scores(docs, labels).join(labels, "doc_id", "left"))
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["quality"] is not None]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.9 * len(held)
    assert len(rows_of(quality_model.quality_scores(odd, labels.limit(0)))) == odd.count()


def test_languages_on_held_out_rows(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = rows_of(language_id.languages(docs).join(docs.select("doc_id", "lang"), "doc_id"))
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    found = rows_of(language_id.languages(odd))
    assert len(found) == odd.count()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in found if r["doc_id"] in (0, 1, 2, 3))
    assert rows_of(language_id.languages(odd.limit(0))) == []


def test_a_long_document_does_not_fill_the_sample_of_a_language(spark):
    """Every sampled document teaches something, a long one from its whole length, within the bound."""
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2][:12]
    middle = " ".join("filler" for _ in range(30_000))
    rows = [(i, f"short {chr(97 + k) * 9} text" if k % 2 else f"long {middle} {chr(97 + k) * 300}", "xx") for k, i in enumerate(ids)]
    text = language_id.training_text(spark.createDataFrame(rows, "doc_id long, text string, lang string"))["xx"]
    assert len(text) <= language_id.LANGUAGE_CHARS
    assert all(chr(97 + k) * 9 in text for k in range(12))


def test_pipeline_stages_take_what_the_one_before_kept(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd_docs = odd.selectExpr("doc_id + 5000000 as doc_id", "text", "lang", "source", "cast(n_tokens as long) as n_chars")
    before = docs.unionByName(odd_docs)
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF)
        assert name == corpus_pipeline.STAGES[-1][0] or after.columns == docs.columns
        kept = {r["doc_id"] for r in after.select("doc_id").collect()}
        assert kept <= {r["doc_id"] for r in before.select("doc_id").collect()} and len(kept) > 0.5 * before.count()
        before = after.cache()
    assert corpus_pipeline.run(spark, SF).where(F.col("n_tokens") <= 0).count() == 0


def test_long_words_are_merged_fast_and_like_the_library(spark):
    """A word of 100,000 letters takes no rounds times length, and no worker remembers it."""
    rng, library = np.random.default_rng(4), {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}
    texts = ["".join("abcdeou"[x] for x in rng.integers(0, 7, n)) for n in (257, 300, 5_000, 100_000)] + ["a" * 3_000, "é" * 700, "x" + "ab" * 400 + " tail"]
    start = time.time()
    for path, splitter in ((WORD, bpe.WordSplitter), (BYTE, token_store.ByteSplitter)):
        with open(path, "rb") as file:
            table = bpe.id_table(file.read(), splitter)
        got = [np.frombuffer(b, "<u4").tolist() for b in table.values(texts)]
        assert got == [library[path].encode(t, add_special_tokens=False).ids for t in texts]
        assert max(map(len, table.known)) <= 64
    assert time.time() - start < 30


def test_quality_weights_do_not_follow_the_partitions(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    few, many = (quality_model.train(docs.repartition(n), labels) for n in (4, 211))
    assert np.array_equal(few, many) and np.count_nonzero(few) > 10


def test_word_and_shingle_hashes_part_texts_like_the_pattern():
    texts = [*ODD, "a b\x0bc\x1cd\x85e f", "A a " * 9, "é É ß", " \t\n", "x" * 5000 + " y"]
    seen = {}
    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        hashes = jaccard_join.word_hashes(text).tolist()
        assert len(hashes) == len(words) and all(seen.setdefault(w, h) == h for w, h in zip(words, hashes, strict=True))
        runs = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
        found = jaccard_join.shingles(text).tolist()
        assert len(found) == len(runs)
        if len(runs) == 1:
            assert seen.setdefault(runs.pop(), found[0]) == found[0]
    assert len(set(seen.values())) == len(seen)


def test_chunk_ids_equal_the_library_at_any_cut(monkeypatch):
    """Odd texts and random mixes, in groups of one text and of all, with a memory that forgets all the time."""
    library, rng = Tokenizer.from_file(BYTE), np.random.default_rng(8)
    with open(BYTE, "rb") as file:
        definition = file.read()
    parts = [" ", " ", "\n", "\n", "\t", "\r", "\x0b", "a", "B", "the", "1", "23", "'", "'s", "'ll", ".", ",", "!", "-", "(", "|", "\xe9", "\xd7", "\u024f", "\u0250", "\xb2", "\u0301", "\u2019", "\u65e5", "\u0391", "\u0436", "\U0001f600", "\x00", "\x7f"]
    unusual = [chr(c) for a, b in byte_chunks.UNUSUAL_SPACES for c in (a, b)] + ["<|", "<|endoftext|>"]
    mixed = ["".join(rng.choice(p, rng.integers(0, 25))) for p in (parts, parts + unusual) for _ in range(1500)]
    texts = [*ODD, *mixed, "x" + "ab" * 400 + " tail", "", "  \n ", "a \n", " b"]
    for group, limit in ((1, 1_000), (2_000, 0), (1 << 20, 1_000)):
        monkeypatch.setattr(byte_chunks, "GROUP", group)
        monkeypatch.setattr(token_store, "CACHE", limit)
        table = token_store.id_table(definition, 2)
        got = [np.frombuffer(b, "<u2").tolist() for b in table.values(pa.array(["before", *texts], pa.string()).slice(1))]
        assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert max(map(len, table.known)) <= 64
    assert list(table.values(pa.array([], pa.string()))) == []


def test_token_store_asks_the_library_once_for_a_chunk_and_costs_less_than_word_by_word(monkeypatch):
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].combine_chunks()
    with open(BYTE, "rb") as file:
        definition = file.read()
    table, words, asked = token_store.id_table(definition, 2), bpe.id_table(definition, token_store.ByteSplitter, 2), []
    expected = words.values(texts.to_pylist())
    assert list(table.values(texts)) == expected
    monkeypatch.setattr(table, "library", lambda chunks: asked.extend(chunks) or [])
    start = time.process_time()
    words.values(texts.to_pylist())
    middle = time.process_time()
    assert list(table.values(texts)) == expected and asked == []
    assert time.process_time() - middle < 0.75 * (middle - start)
