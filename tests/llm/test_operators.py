"""Each operator against a brute-force version, and on nulls, blanks, repeats and empty tables."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from docketlake.llm import chat, decontamination, private_data, secrets, sharding, simhash_dedup
from docketlake.llm.queries import ORACLES, QUERIES

OPS = [n for n in QUERIES if n != "pipeline"]


def rows(frame):
    return [r.asDict() for r in frame.collect()]


@pytest.mark.parametrize("name", OPS)
def test_empty_tables_give_no_rows(spark, empty, name):
    found = rows(QUERIES[name](spark, empty))
    assert all(r["conv_id"] == -1 for r in found) if name.startswith("op5") else found == []


def test_pipeline_on_empty_tables(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0


@pytest.mark.parametrize("name", ORACLES)
def test_sql_agrees_on_nulls_blanks_and_repeats(spark, small, name):
    base = duckdb.connect()
    for table in ("documents", "conversations", "embeddings"):
        base.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{small}/{table}.parquet/*.parquet')")
    answer, got = base.sql(ORACLES[name]), QUERIES[name](spark, small)
    assert sorted(answer.columns) == sorted(got.columns)
    assert sorted(answer.fetchall(), key=repr) == sorted(map(tuple, got.select(*answer.columns).collect()), key=repr)


def test_quality_base_metrics(spark, small):
    texts = {r["doc_id"]: r["text"] or "" for r in rows(spark.read.parquet(f"{small}/documents.parquet"))}
    found = rows(QUERIES["op2_quality_rules"](spark, small))
    assert len(found) == 12
    for r in found:
        w = texts[r["doc_id"]].split()
        windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        seen = Counter(windows)
        covered = {i + j for i, x in enumerate(windows) if seen[x] > 1 for j in range(3)}
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(covered))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r["kept"] and r["base_failed"])


def test_private_base_spans(spark, small):
    pat = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"}
    texts = ["a@b.c_d@e.f x@y..z a.b@c.d.", "é a@b.co 1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4", "a@b@c.d.e@f.g", "𝒳x@y.zz", "", "a." * 3000 + "@b" + ".c" * 3000]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in rows(frame.select("i", private_data.base_spans(frame["t"]).alias("s"))):
        want = [(k, m.start(), m.end()) for k, p in pat.items() for m in re.finditer(p, texts[r["i"]])
                if k == "email" or all(int(x) <= 255 for x in m.group().split("."))]
        assert [tuple(s) for s in r["s"] if s["kind"] in pat] == want
    found = {r["doc_id"]: r for r in rows(QUERIES["op3_private_data"](spark, small))}
    assert (found[8]["n_email"], found[8]["n_ip"]) == (1, 1)
    assert found[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_by_pattern(text):
    """Per kind the spans of the contract's patterns, failing matches dropped."""
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.group().split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15)]
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in rules for m in re.finditer(p, text) if ok(m)]


def test_private_data_on_all_documents(spark, sf_dir, small):
    for folder in (sf_dir, small):
        texts = {}
        for r in rows(spark.read.parquet(f"{folder}/documents.parquet")):
            texts.setdefault(r["doc_id"], r["text"] or "")
        kinds = Counter()
        for r in rows(QUERIES["op3_private_data"](spark, folder)):
            want = base_by_pattern(texts[r["doc_id"]])
            counts = Counter(w.split(":")[0] for w in want)
            assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
            assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [counts[k] for k in private_data.BASE]
            assert [s for s in r["spans"].split(",") if s][:len(want)] == want
            kinds += counts
        assert folder == small or all(kinds[k] for k in private_data.BASE)


def test_card_and_phone_edges(spark):
    texts = ["4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111 1111 1111", "0" * 19, "0" * 20, "+1 (555) 010-9999 x", "+1234567", "+1-", "++4930 123456-", "x4111111111111111- +44.20.7946.0958 4111"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in rows(frame.select("i", private_data.base_spans(frame["t"]).alias("s"))):
        assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["s"]] == base_by_pattern(texts[r["i"]])


def test_simhash_groups(spark, small):
    found = rows(QUERIES["op4_simhash_near_dedup"](spark, small))
    fps = [int(r["fingerprint"], 16) for r in found]
    group = list(range(len(found)))
    for _ in found:
        for i, a in enumerate(fps):
            group[i] = min(group[j] for j, b in enumerate(fps) if (a ^ b).bit_count() <= 3)
    for i, r in enumerate(found):
        ids = [found[j]["doc_id"] for j in range(len(found)) if group[j] == group[i] and found[j]["doc_id"] is not None]
        assert r["component_id"] == min(ids, default=None)


def test_links_lose_nothing_in_dense_postings(spark):
    r = np.random.default_rng(3)
    base = [int(x) for x in r.integers(-2**62, 2**62, 3)]
    fps = sorted({b ^ sum(1 << int(i) for i in r.choice(12, r.integers(0, 6))) for b in base for _ in range(300)})
    found = {tuple(x) for x in simhash_dedup.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    assert found == {(a, b) for i, a in enumerate(fps) for b in fps[i + 1:] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}


def test_chat_reads_back(spark, small):
    data = spark.read.parquet(f"{small}/conversations.parquet")
    done = chat.format_conversations(data)
    got = {r["conv_id"]: r for r in rows(done.select("conv_id", "formatted", chat.read_turns(done["formatted"]).alias("turns"), chat.masked_text(done["formatted"], done["loss_spans"]).alias("loss")))}
    assert [tuple(t) for t in got[1]["turns"]] == [("user", ""), ("assistant", "b <|im_end|> \\ <\\|x|>"), ("assistant", "c\nd"), ("assistant", "c\nd")]
    assert got[1]["loss"] == "b <|im_end|> \\ <\\|x|>c\ndc\nd" and got[1]["formatted"].count("<|im_start|>") == 2
    assert [tuple(t) for t in got[None]["turns"]] == [("", "x")]


@pytest.mark.parametrize("name", ["op6_quality_crf", "op8_toxicity"])
def test_scores_cover_all_rows(spark, small, name):
    found = rows(QUERIES[name](spark, small))
    assert len(found) == 12 and all(0 <= r["score"] <= 1 for r in found)


def test_shards_are_balanced_and_gapless(spark, sf_dir):
    found = rows(QUERIES["op7_sharding"](spark, sf_dir))
    load = Counter()
    for r in found:
        load[r["shard"]] += r["size"]
    for shard in load:
        assert sorted(r["slot"] for r in found if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in found)))
    assert max(load.values()) - min(load.values()) <= max(r["size"] for r in found)


def test_rebalancing_moves_little():
    weights = {s: (10, 1) for s in range(64)}
    owners = sharding.rebalance(sharding.first_map(4, 64), weights, 4)
    grown = sharding.rebalance(owners, weights, 5)
    assert owners == sharding.first_map(4, 64)
    assert all(a == b or b == 4 for a, b in zip(owners, grown)) and grown.count(4) in (12, 13)


def test_mix_meets_targets(spark, sf_dir, small):
    for folder in (sf_dir, small):
        found = rows(QUERIES["op9_mixing"](spark, folder))
        again = rows(QUERIES["op9_mixing"](spark, folder))
        assert sorted((r["doc_id"] or -1, r["taken"]) for r in found) == sorted((r["doc_id"] or -1, r["taken"]) for r in again)
        assert all(r["taken"] <= 2 * r["size"] for r in found)
        taken, target, largest = Counter(), {}, Counter()
        for r in found:
            taken[r["source_size"], r["target"]] += r["taken"]
            largest[r["source_size"], r["target"]] = max(largest[r["source_size"], r["target"]], r["size"])
        assert all(abs(v - k[1]) <= largest[k] for k, v in taken.items())


def test_leaks_by_brute_force(spark, small, sf_dir):
    assert {(r["doc_id"], r["item_id"], r["item_copies"]) for r in rows(QUERIES["op10_benchmark_decontamination"](spark, small))} == {(7, 0, 2)}
    plain = lambda t: f" {' '.join(decontamination.normal_words(t))} "
    items = [(r["item_id"], plain(r["text"])) for r in rows(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))]
    want = {(r["doc_id"], i) for r in rows(spark.read.parquet(f"{sf_dir}/documents.parquet")) for i, t in items if t in plain(r["text"])}
    found = {(r["doc_id"], r["item_id"]) for r in rows(QUERIES["op10_benchmark_decontamination"](spark, sf_dir))}
    assert want and want <= found


def test_secrets(spark, small):
    found = rows(QUERIES["op1_secret_scan"](spark, small))
    assert [r["candidate"] for r in found if r["secret"]] == ["0123456789abcdef0123456789abcdef01234567"]


def test_secret_values_of_any_assignment(spark):
    hexes, url, aws = "9f8a7b6c5d4e3f2a1b0c9d8e7f6a5b4c", "c2lnbmF0dXJlLW9mLWEtdXJs", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
    want = {
        f"api_key={hexes}": [hexes], f"get /x?sig={url}==&n=1": [url + "=="], f"?token={hexes[:9]}&page=2": [hexes[:9]], f"AWS_SECRET_ACCESS_KEY={aws}": ["AWS_SECRET_ACCESS_KEY", aws],
        f'AWS_SECRET_ACCESS_KEY="{aws}"': ["AWS_SECRET_ACCESS_KEY", aws], 'password = "hunter2!x"': ["hunter2!x"], "pwd: 'it is \\' s3cret'": ["it is \\' s3cret"],
        '{"password": "p@ss, w0rd", "n": 1}': ["p@ss, w0rd"], "DB_PASSWORD=Ab&c,d;12!, then": ["Ab&c,d;12!"], "password: Abcdefghijklmnopq!rs.": ["Abcdefghijklmnopq!rs"],
        f"api: https://h.io/?api_key={hexes}": [hexes], f"keys: {hexes},{aws}": [hexes, aws], f'token = "Bearer {hexes}"': ["Bearer", hexes],
        f'"{url}=="': [url + "=="], 'key = "" or key == 1 pwd="x"': [], "the author: someone wrote": [], "key:" + "." * 50000: ["." * 49992], 'token="' + "a\\" * 50000: ["a\\" * 50000]}
    frame = spark.createDataFrame([(i, "s", t) for i, t in enumerate(want)], "doc_id int, source string, text string")
    found = {}
    for r in sorted(rows(secrets.findings(frame, ["doc_id"], "source")), key=lambda r: r["start"]):
        text = list(want)[r["doc_id"]]
        assert text[r["start"]:r["end"]] == r["candidate"]
        found.setdefault(text, []).append(r["candidate"])
    assert {t[:60]: found.get(t, []) for t in want} == {t[:60]: w for t, w in want.items()}
    assert [r["label"] for r in rows(secrets.labelled_by_assignment(secrets.findings(frame, ["doc_id"], "source"))) if r["candidate"] == aws and r["doc_id"] == 4] == [1.0]


def test_pipeline_stages_keep_columns_and_clean_texts(spark, small):
    docs, kept = spark.read.parquet(f"{small}/documents.parquet"), {}
    columns = docs.columns
    for name, step in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(step(spark, docs, small), "test")
        if name != "sharding":
            assert docs.columns == columns
        kept[name] = [r["doc_id"] for r in docs.select("doc_id").collect()]
    assert {5, 7, 8, 9, None} <= set(kept["quality rules"]) and not {0, 1, 2, 3, 4} & set(kept["quality rules"])
    assert sorted(kept["near-duplicates"], key=str) == [5, 7, 8, 9, None]
    assert 7 not in kept["decontamination"] and {5, 8, 9, None} == set(kept["decontamination"])
