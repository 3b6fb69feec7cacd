"""Inventories, refreshed tables, corpora, correction maps and document scores on small fixtures."""

import hashlib
import itertools
import json
import random

from pyspark.sql import functions as F

from ledgerloom.functions import groups, text
from ledgerloom.operators import benchmarking, curation
from ledgerloom.sources import corpora


def tree_digest(content: bytes) -> str:
    """The digest of one file by its rule, in plain Python."""
    lines = content.split(b"\n")
    lines = lines[:-1] if content.endswith(b"\n") else lines
    offset, ranges = 0, {}
    for line in lines:
        ranges.setdefault(offset // corpora.RANGE_BYTES, []).append(f"{offset}:{hashlib.sha256(line).hexdigest()}")
        offset += len(line) + 1
    level = [hashlib.sha256(",".join(r).encode()).hexdigest() for _, r in sorted(ranges.items())]
    while True:
        level = [hashlib.sha256("".join(level[i : i + corpora.FAN]).encode()).hexdigest() for i in range(0, len(level), corpora.FAN)]
        if len(level) == 1:
            return level[0]


def test_digests_do_not_follow_the_byte_ranges_that_tasks_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpora, "RANGE_BYTES", 4096)
    monkeypatch.setattr(corpora, "FAN", 4)
    rng = random.Random(3)
    contents = {"a.bin": bytes(rng.randrange(256) for _ in range(60_000)), "b.txt": b"one\n\ntwo\r\nthree", "c.txt": b"x" * 9000 + b"\n" + b"y\n" * 3000}
    for name, content in contents.items():
        (tmp_path / "train").mkdir(exist_ok=True)
        (tmp_path / "train" / name).write_bytes(content)
    (tmp_path / "train" / "empty.txt").write_bytes(b"")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    found = []
    for size in ("5k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        found.append({r["file"].rsplit("/", 1)[1]: r["digest"] for r in corpora.file_digests(spark, str(tmp_path)).collect()})
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found[0] == found[1] == {name: tree_digest(c) for name, c in contents.items()}
    row = corpora.file_inventory(spark, str(tmp_path)).collect()
    assert len(row) == 1 and (row[0]["files"], row[0]["bytes"], row[0]["train"]) == (3, sum(map(len, contents.values())), 3)


def test_metadata_fingerprint_sees_a_change_without_reading(spark, tmp_path):
    (tmp_path / "x.txt").write_text("abc")
    prints = lambda: corpora.metadata_fingerprint(corpora.file_names(spark, str(tmp_path)), str(tmp_path)).first()
    first = prints()
    assert (first["files"], first["bytes"]) == (1, 3) and prints() == first
    (tmp_path / "x.txt").write_text("abcd")
    assert prints() != first


def test_refresh_rewrites_changed_sources_only(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = [(i, f"s{i % 3}", f"t{i}") for i in range(30)]
    table = lambda r: spark.createDataFrame(r, "id long, source string, text string")
    changed = lambda run, r: sorted(x["source"] for x in corpora.refresh_sources(table(r), path, run, ["id", "text"]).collect())
    assert changed(1, rows) == ["s0", "s1", "s2"]
    files = lambda: {p.parent.name + "/" + p.name for p in (tmp_path / "table" / "rows").rglob("*.parquet")}
    first = files()
    later = [(i, s, t + "!" if i == 4 else t) for i, s, t in rows if s != "s2"] + [(99, "new", "n")]
    assert changed(2, later) == ["new", "s1"]
    assert {f for f in first if not f.startswith("source=s1")} <= files()  # only one old partition was written again
    assert changed(2, later) == ["new", "s1"]  # a repeated run does the same
    assert changed(3, later) == []
    got = sorted((r["id"], r["source"], r["text"]) for r in corpora.refreshed(spark, path).select("id", "source", "text").collect())
    assert got == sorted(later)


def test_corpora_pair_siblings_by_key(spark, tmp_path):
    quad = {f"{a}{i}": v for i, (x, y) in enumerate(((10, 10), (50, 10), (50, 30), (10, 30)), 1) for a, v in (("x", x), ("y", y))}
    for folder in ("n/train", "b/test/box", "b/test/entities"):
        (tmp_path / folder).mkdir(parents=True)
    line = lambda *w: {"category": "menu", "words": [{"text": x, "quad": quad} for x in w]}
    (tmp_path / "n/train/r1.json").write_text(json.dumps({"valid_line": [line("Tea ", "x2"), line(" "), line("Cake")]}))
    (tmp_path / "b/test/box/f1.txt").write_text("1,2,30,2,30,12,1,12,TOTAL, 5\nbad,line\n1,2,30,2,30,12,1,12,Last\n1,2,30,2,30,12,1,12,br�ken\n")
    (tmp_path / "b/test/box/f2.txt").write_text("1,2,30,2,30,12,1,12,Alone\n")
    (tmp_path / "b/test/box/f3.txt").write_text("nothing\n")
    (tmp_path / "b/test/entities/f1.txt").write_text('{"company": "ACME", "total": "5"}')
    (tmp_path / "b/test/entities/f2.txt").write_text("{broken")
    rows = corpora.read_corpora(spark, str(tmp_path / "n"), str(tmp_path / "b/test/box"), str(tmp_path / "b/test/entities"))
    got = {r["row_id"]: r for r in rows.collect()}
    assert set(got) == {"nested:r1:line:0", "nested:r1:line:2", "nested:r1:document", "boxed:f1:line:0", "boxed:f1:line:2", "boxed:f1:document", "boxed:f2:line:0", "boxed:f2:document"}
    assert (got["nested:r1:document"]["text"], got["nested:r1:line:0"]["split"], got["nested:r1:line:0"]["fields"]) == ("Tea x2\nCake", "train", {"category": "menu"})
    assert (got["boxed:f1:document"]["text"], got["boxed:f1:document"]["fields"]) == ("TOTAL, 5\nLast", {"company": "ACME", "total": "5"})
    assert got["boxed:f2:document"]["fields"] == {} and not got["boxed:f1:document"]["usable_for_training"]


def test_json_masking_keeps_keys_and_escapes(spark):
    payload = {"name": 'Ayşe "x" 12', "n": 42, "deep": [{"k1": "b2\n"}, None, True, "c\\d"], "é": "ü"}
    got = json.loads(spark.createDataFrame([(json.dumps(payload),)], "p string").select(text.mask_json(F.col("p"))).first()[0])
    assert got == {"name": 'XXXX "X" 00', "n": 42, "deep": [{"k1": "X0\n"}, None, True, "X\\X"], "é": "X"}


def test_last_corrections_win(spark):
    docs = spark.createDataFrame([(1, "receipt", "scan-1"), (2, "invoice", "scan-2")], "id long, kind string, safe_name string")
    rows = [(1, "total", "1", "2", 1), (1, "total", None, "3", 5), (1, None, "a", "first", 2), (1, "raw_ocr_text", "b", "Last 9", 4), (1, "date", "x", None, 3)]
    fixes = spark.createDataFrame(rows, "document_id long, field string, before_value string, after_value string, ord int")
    plain = {r["id"]: r for r in curation.correction_dataset(docs, fixes, False).collect()}
    assert plain[1]["corrected_text"] == "Last 9" and plain[1]["corrected_fields"] == {"total": "3", "date": ""} and plain[1]["previous_fields"] == {"total": None, "date": "x"}
    assert plain[2]["corrected_text"] is None and plain[2]["corrected_fields"] == {}
    hidden = {r["id"]: r for r in curation.correction_dataset(docs, fixes, True).collect()}
    assert hidden[1]["corrected_text"] == "XXXX 0" and hidden[1]["safe_name"] == "XXXX-0"


def test_positions_of_groups_of_any_size(spark):
    rows = [(None if i % 5 == 0 else i % 2, i * 37 % 50, i) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, v int, id int").repartition(7)
    got = groups.positions(df, ["g"], [F.desc("v"), F.asc("id")], "n", "size").collect()
    want = {}
    for g, members in itertools.groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, -r[1], r[2])), key=lambda r: r[0]):
        members = list(members)
        want |= {m[2]: (k + 1, len(members)) for k, m in enumerate(members)}
    assert {r["id"]: (r["n"], r["size"]) for r in got} == want
    assert groups.positions(df.limit(0), ["g"], [F.asc("v")]).collect() == []


def greedy(truth, preds):
    def iou(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        inter = max(0, w) * max(0, h)
        return inter / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter)

    used_t, used_p, out = set(), set(), []
    for score, t, p in sorted((-iou(a, b), t, p) for t, a in enumerate(truth) for p, b in enumerate(preds)):
        if -score >= 0.5 and t not in used_t and p not in used_p:
            used_t.add(t)
            used_p.add(p)
            out.append((t, p))
    order = sorted(out)
    pairs = list(itertools.combinations(order, 2))
    return sorted(out), (sum(a[1] < b[1] for a, b in pairs) / len(pairs) if pairs else 1.0)


def test_box_matches_equal_the_sequential_choice(spark):
    rng, rows, want = random.Random(11), [], {}
    for doc in range(30):
        box = lambda: (lambda x, y: (x, y, x + rng.randrange(8, 30), y + rng.randrange(6, 14)))(rng.randrange(60), rng.randrange(60))
        truth = [box() for _ in range(rng.randrange(14))]
        preds = [tuple(c + rng.randrange(-2, 3) for c in b) for b in rng.sample(truth, len(truth))] + [box() for _ in range(rng.randrange(4))]
        rows += [(doc, kind, k, *b) for kind, boxes in (("truth", truth), ("pred", preds)) for k, b in enumerate(boxes)]
        want[doc] = greedy(truth, preds)
    boxes = spark.createDataFrame(rows, "doc_id int, kind string, ord int, x1 int, y1 int, x2 int, y2 int")
    matches = curation.greedy_matches(curation.box_pairs(boxes, 16)).collect()
    assert {d: sorted((m["truth"], m["pred"]) for m in matches if m["doc_id"] == d) for d in want} == {d: w[0] for d, w in want.items()}
    scores = {r["doc_id"]: r for r in curation.box_detection_scores(boxes).collect()}
    assert {d: r["order_accuracy"] for d, r in scores.items()} == {d: round(want[d][1], 6) for d in scores}


def test_scoring_extractor_lets_the_last_line_win(spark):
    body = "ACME LTD\nSatıcı: Gerçek A.Ş.\nTARIH 03.02.24 saat 9\nKDV 1,00\nKDV %18 18,50\nARA TOPLAM 100,00\nTOPLAM 50,00\nSüt 2 %10 12,50\nEkmek 3 x 5,00 15,00 TL\nKREDI KARTI"
    df = spark.createDataFrame([(1, body, "unknown"), (2, "", "receipt"), (3, None, "unknown"), (4, "FATURA\nToplam 1.234,50 ₺\nkasa", "receipt")], "id int, text string, hint string")
    got = {r["id"]: r.asDict() for r in benchmarking.structured_fields(df, hint="hint", keep=("id",)).collect()}
    assert {k: got[1][k] for k in ("date", "tax", "subtotal", "total", "merchant", "paymentMethod", "documentType")} == {
        "date": "2024-02-03", "tax": "1850", "subtotal": "10000", "total": "11850", "merchant": "Gerçek A.Ş.", "paymentMethod": "KART", "documentType": None}
    assert got[2]["documentType"] == "receipt" and got[3]["merchant"] is None
    assert (got[4]["documentType"], got[4]["total"], got[4]["currency"], got[4]["merchant"]) == ("invoice", "123450", "TRY", "kasa")
    items = df.select("id", F.explode(benchmarking.scored_items(F.col("text"))).alias("i")).where("id = 1").select("i.*").collect()
    assert [tuple(i) for i in items] == [("Süt", "1250"), ("Ekmek", "1500")]
