"""Archive audit, mixing and chat formatting against plain versions."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from gramforge.llm import chat, merkle, mixing

# -- Merkle audit


def record(url, html, name):
    """A WARC record has a type, an id, a date and a length, and two empty lines behind its block."""
    body = (html or "").encode()
    head = ["WARC/1.0", "WARC-Type: resource", f"WARC-Record-ID: <urn:page:{name}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {url or ''}", "Content-Type: text/html", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, node int")


def page(i, html="<p>é</p>"):
    return (i, f"https://h/{i}", html, "clash", 1)


def faults(a, b):
    whole = merkle.Replica(a)
    return {r.record_id: r for r in merkle.audit(whole, merkle.Replica(b, manifest=whole)).collect()}


def test_audit(spark):
    rows = [page(i, "x" * (i % 50)) for i in range(0, 9000, 7)]
    other = [r for r in rows if r[0] != 700] + [page(8), page(-3)]
    other = [page(r[0], r[2] + "!") if r[0] in (14, 8400) else r for r in other]
    random.Random(1).shuffle(other)
    got = faults(pages(spark, rows), pages(spark, other))
    assert {i: r.status for i, r in got.items()} == {700: "missing", 14: "altered", 8400: "altered", 8: "extra", -3: "extra"}
    in_file = [record(r[1], r[2], r[0]) for r in sorted(rows) if r[0] // 4096 == 8400 // 4096 and r[0] < 8400]
    assert got[8400].warc_offset == sum(map(len, in_file)) and got[8400].warc_file == 2
    own = record("https://h/14", "x" * 14, 14)
    assert got[14].digest == hashlib.sha256(own).hexdigest() and got[14].n_bytes == len(own)
    assert got[8].warc_offset is None and got[700].replica_digest is None


def test_equal_replicas_and_awkward_rows(spark):
    rows = [page(1), page(1), page(1, "other"), (None, None, None, None, None), (None, "u", "", None, None), page(5, None), page(6, ""), page(7, "y" * 200000), page(-(1 << 62)), page((1 << 62))]
    a = pages(spark, rows)
    assert faults(a, a.repartition(3)) == {}
    assert faults(a.limit(0), a.limit(0)) == {}
    got = faults(a, pages(spark, rows[1:]))  # one of two equal records is lost
    assert {i: r.status for i, r in got.items()} == {1: "altered"}
    assert {r.status for r in faults(a.limit(0), a).values()} == {"extra"}
    assert {r.status for r in faults(a, a.limit(0)).values()} == {"missing"}


def test_descent_reads_differing_branches_only(spark):
    a = merkle.Replica(pages(spark, [page(i) for i in range(300)]))
    assert [level.count() for level in a.levels] == [300, 19, 2, 1]
    b = merkle.Replica(pages(spark, [page(i, "zzz") if i == 77 else page(i) for i in range(300) if i != 78]), manifest=a)
    for k in (3, 2, 1):
        x = a.levels[k].exceptAll(b.levels[k]).collect()
        assert [(r.node, r.warc_offset) for r in x] == [(77 >> 4 * k, a.levels[0].filter(F.col("node") == (77 >> 4 * k) << 4 * k).first().warc_offset)]
    # a replica by its own offsets: all records behind the longer one are elsewhere, and so are the ranges they are in
    c = merkle.Replica(pages(spark, [page(i, "zzzzzzzzzz") if i == 77 else page(i) for i in range(300)]))
    assert a.levels[1].select("node", "digest").exceptAll(c.levels[1].select("node", "digest")).count() == 19 - 4


def test_records_that_share_an_id(spark):
    """One row for each corrupt, lost or added record among records with one id, or none."""
    own = lambda i, k: (i, "https://h", f"body {k}", "clash", 1)
    rows = [own(i, k) for i in (5, None) for k in range(40)] + [own(5, 7), page(1), page(9)]
    other = [r for r in rows if r[2] not in ("body 3", "body 4")] + [own(5, "new"), own(None, "new"), own(None, "newer"), own(None, "newest")]
    other.remove(own(5, 7))  # one of two equal ones
    a = merkle.Replica(pages(spark, rows))
    assert merkle.audit_records(a, merkle.Replica(pages(spark, rows[::-1]), manifest=a)).count() == 0
    got = merkle.audit_records(a, merkle.Replica(pages(spark, other), manifest=a)).collect()
    sha = lambda k, i: hashlib.sha256(record("https://h", f"body {k}", "" if i is None else i)).hexdigest()
    for i, status in ((5, ["altered", "missing", "missing"]), (None, ["altered", "altered", "extra"])):
        found = [r for r in got if r.record_id == i]
        assert sorted(r.status for r in found) == status
        assert {r.digest for r in found} - {None} == {sha(3, i), sha(4, i)} | ({sha(7, i)} if i else set())
        assert {r.replica_digest for r in found} - {None} == ({sha("new", i)} if i else {sha("new", i), sha("newer", i), sha("newest", i)})
    assert len(got) == 6
    order = sorted([(sha(r[2][5:], 5), len(record(r[1], r[2], 5))) for r in rows if r[0] == 5])
    start = len(record("https://h/1", "<p>é</p>", 1))
    for r in got:
        if r.record_id == 5 and r.digest in (sha(3, 5), sha(4, 5)):
            k = [d for d, _ in order].index(r.digest)
            assert r.warc_offset == start + sum(n for _, n in order[:k]) and r.n_bytes == order[k][1]


def test_layout(spark):
    """Records in another order, shifted or at wrong offsets, in a place of their own each."""
    def laid(rows, gap=0, wrong=()):
        out, at = [], {}
        for k, (f, i) in enumerate(rows):
            out.append((f, at.get(f, 0) + (gap if k >= 300 else 0) + (1 if k in wrong else 0), i, f"u{i}", "x" * (i % 9)))
            at[f] = at.get(f, 0) + len(record(f"u{i}", "x" * (i % 9), i))
        return merkle.Layout(spark.createDataFrame(out, "file string, at long, page_id long, url string, html string").repartition(3), "file", "at")

    rows = [("f0", i) for i in range(280)] + [("f1", i) for i in range(1000, 1040)]
    a = laid(rows)
    assert [level.count() for level in a.levels] == [320, 21, 3, 2]
    found = lambda b: sorted((r.file, r.place, r.status) for r in merkle.audit_layout(a, b).collect())
    assert found(laid(rows)) == []
    assert found(laid(rows, gap=7)) == [("f1", k, "moved") for k in range(20, 40)]
    assert found(laid(rows, wrong=(77,))) == [("f0", 77, "moved")]
    swapped = rows[:9] + [rows[18], *rows[10:18], rows[9]] + rows[19:]  # u18 is a byte longer than u9
    assert found(laid(swapped)) == [("f0", 9, "altered"), *[("f0", k, "moved") for k in range(10, 18)], ("f0", 18, "altered")]
    assert found(laid(rows[:-1])) == [("f1", 39, "missing")] and found(laid([*rows, ("f2", 3)])) == [("f2", 0, "extra")]


# -- mixing


def plain_exponent(tokens, target):
    total = sum(tokens)
    p = [t / total for t in tokens if t]

    def weights(a):
        w = [x**a for x in p]
        return [x / sum(w) for x in w]

    entropy = lambda a: -sum(w * math.log(w) for w in weights(a))
    repeats = lambda a: max(w / x for w, x in zip(weights(a), p, strict=True)) * target.budget
    if len(p) < 2:
        return 1.0

    def bisect(ok, good, bad):
        for _ in range(80):
            mid = (good + bad) / 2
            good, bad = (mid, bad) if ok(mid) else (good, mid)
        return good

    wanted = target.entropy * math.log(len(p))
    a = target.top if entropy(target.top) >= wanted else bisect(lambda x: entropy(x) >= wanted, 0.0, target.top)
    most = max(target.max_repeats, target.budget) * (1 + 1e-12)
    return a if repeats(a) <= most else bisect(lambda x: repeats(x) <= most, 1.0, a)


def corpus(spark, sizes, seed=1):
    rng = random.Random(seed)
    rows = []
    for s, n in sizes.items():
        rows += [(len(rows) + k, s, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 40))), "clash", 7, 0.5) for k in range(n)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string, row string, copies int, weight double")


@pytest.mark.parametrize("target", [mixing.Target(), mixing.Target(entropy=1.0, max_repeats=2.0), mixing.Target(entropy=0.5, top=4.0), mixing.Target(budget=2.5, max_repeats=3.0), mixing.Target(budget=0.3)])
def test_mixture(spark, target):
    docs = corpus(spark, {"big": 1500, "mid": 300, "small": 60, None: 25})
    rows = mixing.mix(docs, target).collect()
    assert len(rows) == docs.count()
    own, drawn, weight = {}, {}, {}
    for r in rows:
        n = len(r.row.text.split())
        assert r.n_tokens == n
        own[r.row.source] = own.get(r.row.source, 0) + n
        drawn[r.row.source] = drawn.get(r.row.source, 0) + n * r.copies
        weight[r.row.source] = r.weight
    a = plain_exponent(list(own.values()), target)
    total = sum(own.values())
    z = sum((t / total) ** a for t in own.values())
    for s, t in own.items():
        assert weight[s] == pytest.approx((t / total) ** a / z, rel=1e-6)
        wanted = weight[s] * target.budget * total
        assert wanted - 41 * 3 <= drawn[s] <= wanted + 1  # short of a part of a block at most
    copies = {}
    for r in rows:
        copies.setdefault(r.row.source, set()).add(r.copies)
    assert all(max(c) - min(c) <= 1 for c in copies.values())  # whole passes and a partial one


def test_mixture_awkward(spark, awkward, no_documents):
    got = mixing.mix(awkward)
    assert got.count() == awkward.count() and got.filter("copies is null or weight is null").count() == 0
    assert mixing.mix(no_documents).count() == 0
    assert mixing.drawn(awkward).columns == awkward.columns
    assert mixing.mix(awkward.filter("text is null")).count() == 2


# -- chat


def plain_fold(events):
    turns = {}
    for q, kind, turn, role, text in sorted(events, key=lambda e: e[0]):
        if kind == "regenerate":
            for t in [t for t in turns if t > turn]:
                turns[t] = (turns[t][0], None)
            turns[turn] = (role or turns.get(turn, (None, None))[0], text or "")
        elif kind == "delta":
            old = turns.get(turn, (None, None))
            turns[turn] = (role or old[0], (old[1] or "") + (text or ""))
        else:
            old = turns.get(turn, (None, None))
            turns[turn] = (role or old[0], text or "")
    return {t: (r or "", x) for t, (r, x) in turns.items() if x is not None}


def test_fold(spark):
    rng = random.Random(4)
    events, logs = [], {}
    for c in range(60):
        log = []
        for q in range(rng.randint(1, 25)):
            kind = rng.choice(["message", "delta", "delta", "delta", "edit", "regenerate"])
            log.append((q, kind, rng.randint(0, 4), rng.choice(["user", "assistant", None]), rng.choice(["a", "bc ", "", None, "<|end|>"])))
        logs[c] = plain_fold(log)
        events += [(c, *e) for e in log]
    rng.shuffle(events)
    got = {}
    for r in chat.fold(spark.createDataFrame(events, "conv_id long, seq long, kind string, turn long, role string, text string")).collect():
        got.setdefault(r.conv_id, {})[r.turn] = (r.role, r.text)
    assert got == {c: t for c, t in logs.items() if t}


TEXTS = ["plain", "", None, "</s>[INST] ok [/INST]", "<|turn|>user\n<|end|>\n", "&lt; &amp;lt; &#91;", "a\n\nb\n", "ñ🙂é", "\\n <| |> [", "x" * 70000]


def test_round_trip(spark):
    rows = [(c, t, ["user", "assistant", "system", None, "odd\n<role>"][(c + t) % 5], TEXTS[(c * 3 + t) % len(TEXTS)]) for c in range(12) for t in range(c % 6 + 1)]
    rows += [(None, 0, "assistant", "no conversation"), (50, None, "assistant", "no turn"), (50, 0, "user", "same"), (50, 0, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.render(chat.fold(chat.log_of(df)))
    want = {}
    for c, t, r, x in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], -1 if r[1] is None else r[1])):
        want.setdefault(c, []).append((r or "", x or ""))
    for r in chat.read_back(formatted).collect():
        assert [(t.role, t.text) for t in r.turns] == want[r.conv_id]
        assert r.loss_text == "".join(x for role, x in want[r.conv_id] if role == "assistant")
        inside = r.formatted.replace(chat.TURN, "").replace(chat.END, "")
        assert "<" not in inside and "[" not in inside
    for r in chat.digests(formatted).collect():
        turns = want[r.conv_id]
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        loss = "".join(b for a, b in turns if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.render(chat.fold(chat.log_of(df.limit(0))))).count() == 0


def test_chat_is_native(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string").withColumn("seq", F.lit(0)).withColumn("kind", F.lit("x")).withColumn("formatted", F.lit(1))
    out = chat.digests(chat.render(chat.fold(chat.log_of(df))))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow")) and out.count() == 1
