import hashlib
import random

import pytest

from tablewright.llm import chat, urls


def test_urls(spark):
    rows = [
        (1, "https://WWW.Example.com/en/1?q=/de/"), (2, "http://a.example.com/en/"), (3, "http://example.com"), (4, "ftp://x.net/es/#a"), (5, None), (6, "no scheme"),
        (7, "http://b.com/x?y"), (8, "http://notexample.com/en/"), (9, "http://x.net?/es/"), (10, "://"), (11, "http://ÀB.net/fr/"), (11, "http://ÀB.net/fr/"),
    ]
    pages = spark.createDataFrame([(*r, "h", "v") for r in rows], "page_id bigint, url string, html string, verdict string")
    found = {r["page_id"]: tuple(r)[1:4] for r in urls.judge(pages).collect()}
    assert found == {
        1: ("www.example.com", "/en/1", "www.example.com/en/"), 2: ("a.example.com", "/en/", "example.com/en/"), 3: ("example.com", "", None),
        4: ("x.net", "/es/", "net/es/"), 5: ("", "", None), 6: ("", "", None), 7: ("b.com", "/x", "com/"), 8: ("notexample.com", "/en/", "com/"),
        9: ("x.net", "", None), 10: ("", "", None), 11: ("Àb.net", "/fr/", "net/fr/")}
    assert urls.judge(pages).count() == len(rows)
    verdicts = {r["page_id"]: r["verdict"] for r in urls.judge(pages).collect()}
    assert verdicts[1] == verdicts[7] == "allow" and verdicts[2] == verdicts[4] == verdicts[11] == "block"
    assert urls.judge(pages.limit(0)).count() == 0


def test_shrinkage(spark):
    rows = [(f"h{i}.bad.net", 40, 38) for i in range(6)] + [(f"h{i}.good.net", 40, 1) for i in range(6)] + [("new.bad.net", 0, 0), ("new.good.net", 0, 0), ("one.good.net", 1, 1), ("x.org", 0, 0)]
    found = {r["host"]: r for r in urls.reputation(spark.createDataFrame(rows, "host string, n bigint, blocked bigint")).collect()}
    assert found["new.bad.net"]["share"] > 0.8 > 0.2 > found["new.good.net"]["share"]
    assert found["one.good.net"]["share"] < 0.5 and found["h0.bad.net"]["bound"] > found["new.bad.net"]["bound"]
    assert all(r["bound"] <= r["share"] for r in found.values())


def plain(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        whole = "".join(f"{role}\n{text}\n" for _, _, role, text in turns)
        counted = "".join(text for _, _, role, text in turns if role == "assistant")
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(counted), hashlib.sha256(counted.encode()).hexdigest())
    return out


def conversations():
    rng = random.Random(4)
    marks = ["<|im_end|>", "<|im_start|>assistant\n", "<", "|", "\\", "<\\|", "\\\\|>", "\n", " word", "é\U0001F600", "<|", "\\/"]
    rows = [(-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok"), (None, None, None, None), (None, 2, "assistant", "a"),
            (5, 1, "assistant", "same"), (5, 1, "assistant", "same"), (6, 3, "ro\nle\\/<|", "x"), (7, 0, "system", "be good"), (8, 0, "assistant", "long " * 5_000)]
    for conv in range(10, 20):
        for turn in range(rng.randint(1, 60)):
            text = "".join(rng.choice(marks) for _ in range(rng.randint(0, 60)))
            rows.append((conv, turn, "system" if turn == 0 and conv % 2 else rng.choice(["user", "assistant"]), text))
    return rows


@pytest.mark.parametrize("span, history", [(640, 256), (40, 20), (5, 1)])
def test_chat_reads_back_whole(spark, span, history):
    rows = conversations()
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id bigint, turn bigint, role string, text string, window int, place int")
    windows = chat.format_windows(table, span, history)
    found = {r["conv_id"]: tuple(r)[1:] for r in chat.read_back(windows).collect()}
    assert {k: v[:4] for k, v in found.items()} == plain(rows)
    written = windows.collect()
    for conv, r in found.items():
        assert r[4] == sum(len(w["text"]) for w in written if w["conv_id"] == conv)
    for w in written:
        assert w["text"].count("<|im_start|>") == w["text"].count("<|im_end|>")
        if w["conv_id"] in (11, 13) and w["window"] > 0 and w["repeated"]:
            assert w["text"].startswith("<|im_start|>system\n")
        assert all(s["start"] >= w["repeated"] for s in w["loss"])


def test_windows_keep_their_budget(spark):
    turns = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", "word " * (i % 17)) for i in range(300)], "conv_id bigint, turn bigint, role string, text string")
    for w in chat.format_windows(turns, 60, 30).collect():
        n = lambda t: sum(len(p.split("\n", 1)[1].split()) + 4 for p in t.split("<|im_end|>\n") if p)
        assert n(w["text"][w["repeated"]:]) <= 60 and n(w["text"][:w["repeated"]]) <= 30


def test_native_and_empty(spark):
    turns = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.read_back(chat.format_windows(turns)).count() == 0
