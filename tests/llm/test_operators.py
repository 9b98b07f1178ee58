"""Operators of the subpackage against brute force, the public library and SQL, on small frames."""

from __future__ import annotations

import hashlib
import json
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cargolens.llm import (
    bpe_automaton, chat_links, cross_entropy, decision_list, exact_dedup, fuzzy_lines,
    jaccard_join, packing, token_rollup, url_rules,
)
from cargolens.llm.components import connected_components
from cargolens.llm.oracle import ORACLE_SQL
from cargolens.llm.public_bpe import default_vocabulary
from cargolens.llm.queries import QUERIES
from compare import differences, duck

DOCS = "doc_id long, text string, lang string, source string, kept string"
WORDS = [f"w{k}" for k in range(40)]


def frame(spark, texts, first=0):
    rows = [(first + k, t, "en", "s", "clash") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_vocabulary())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, sf, name):
    assert differences(QUERIES[name](spark, sf), duck(sf), ORACLE_SQL[name]) is None


def test_components_of_chains_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(1, k) for k in range(2, 60)]
    edges += [(70, 70), (None, 71), (80, 79), (79, 80)]
    found = {r["node"]: r["component"] for r in connected_components(
        spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {
        **{k: 100 for k in range(100, 141)}, **{k: 1 for k in range(1, 60)}, 79: 79, 80: 79,
    }


# --- 1 ------------------------------------------------------------------------


def call(name, ident, after=(), **arguments):
    body = {"id": ident, "name": name, "arguments": arguments, "after": list(after)}
    return f"<tool_call>{json.dumps(body)}</tool_call>"


def test_tool_calls(spark):
    def result(k):
        return json.dumps({"tool_call_id": k, "content": 1.0})
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "so " + call("add", "a", x=1) + call("add", "b", ["a", "no"], x="1")),
        (1, 2, "tool", result("b")), (1, 3, "tool", result("a")), (1, 4, "tool", result("a")),
        (1, 5, "assistant", call("add", "a", x=2)), (1, 6, "tool", result("zz")),
        (2, 0, "assistant", call("add", "p", ["q"], x=1) + call("add", "q", ["p"], x=1)),
        (2, 1, "assistant", "<tool_call>{broken</tool_call>"), (2, 2, "tool", "no json"),
        (None, 0, "assistant", call("other", "a")), (None, 1, "tool", result("a")),
        (3, 0, None, None), (3, 1, "tool", result("late")), (3, 2, "assistant", call("add", "late", x=3)),
    ]
    schema = {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer"}}}
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = chat_links.link_tool_calls(df.withColumn("level", F.lit("clash")), {"add": schema})
    got = {(r["conv_id"], r["turn"], r["position"]): r for r in found.collect()}
    status = {k: (r["kind"], r["level"], r["status"], r["valid"]) for k, r in got.items()}
    assert status[1, 1, 0] == ("text", None, None, True)
    assert status[1, 1, 1] == ("call", 0, "linked", True)
    assert status[1, 1, 2] == ("call", 2, "linked", False)
    assert status[1, 2, 0] == ("result", 3, "linked", True)
    assert status[1, 3, 0] == ("result", 1, "linked", True)
    assert status[1, 4, 0][2] == "repeated" and status[1, 5, 0][2] == "repeated"
    assert status[1, 6, 0][2] == "orphan"
    assert {status[2, 0, 0][2], status[2, 0, 1][2]} == {"cyclic"}
    assert status[2, 1, 0] == ("call", None, "malformed", False)
    assert status[2, 2, 0][2] == "malformed"
    assert status[None, 0, 0][2:] == ("linked", False) and status[None, 1, 0][2] == "linked"
    assert status[3, 1, 0][2] == "early" and status[3, 0, 0][0] == "text"
    assert got[1, 3, 0]["json"] == '{"content":1,"tool_call_id":"a"}'
    assert chat_links.link_tool_calls(df.limit(0), {}).count() == 0


def test_depths_of_chains_joins_and_cycles(spark):
    rng = np.random.default_rng(6)
    after = {k: [k - 1] if k else [] for k in range(150)}
    for k in range(150, 220):
        after[k] = sorted({int(x) for x in rng.integers(0, k, rng.integers(0, 4))})
    after |= {300: [301], 301: [300], 302: [301], 303: [302, 5], 304: [304], 305: [999]}
    depth = {}
    for k in sorted(k for k in after if k < 300):
        depth[k] = 1 + max((depth[d] for d in after[k]), default=-1)
    depth[305] = 0
    rows = [(c, str(k), [str(d) for d in v]) for c in (None, 1) for k, v in after.items()]
    calls = spark.createDataFrame(rows, "conv long, id string, after array<string>")
    found = chat_links.dependency_depths(calls).collect()
    assert {(r["conv"], int(r["id"])): r["depth"] for r in found} == {
        (c, k): d for c in (None, 1) for k, d in depth.items()}
    assert len(found) == 2 * len(depth)


# --- 2 ------------------------------------------------------------------------


def test_block_decisions_follow_aliases(spark):
    urls = ["http://a.example.net/1", "https://Bad.example.COM/de/x#f", "http://ok.example.org/x",
            "http://far.net/", None, "no url", "http://c.net/?q=1", "http://a.example.net/1"]
    html = [
        '<link rel="canonical" href="https://bad.example.com/de/x">', "<p>",
        "<LINK href='//bad.example.com/de/x' rel=canonical>",
        '<meta http-equiv="refresh" content="0; url=http://mid.net/y">', "<p>", None,
        '<link rel=canonical href=/other>', "",
    ]
    pages = spark.createDataFrame(list(zip(range(8), urls, html, "x" * 8, strict=True)),
                                  "page_id long, url string, html string, verdict string")
    rules = spark.sql("VALUES ('org', '/', 'allow'), ('com', '/de/', 'block') AS r(host, path, verdict)")
    links = url_rules.page_links(pages).union(
        spark.sql("SELECT 'http://mid.net/y', 'http://a.example.net/1#z'"))
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in
           url_rules.judge_urls(pages, rules, links).collect()}
    assert got == {
        0: (None, "block"), 1: ("com/de/", "block"), 2: ("org/", "allow"), 3: (None, "block"),
        4: (None, "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "block"),
    }
    none = url_rules.judge_urls(pages, rules.limit(0), links.limit(0))
    assert {r["verdict"] for r in none.collect()} == {"allow"}
    assert url_rules.judge_urls(pages.limit(0), rules, links).count() == 0


# --- 3 ------------------------------------------------------------------------


def shingles(text):
    words = exact_dedup.lower_ascii((text or "").encode()).split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_groups(texts):
    sets = {k: shingles(t) for k, t in texts.items()}
    parent = {k: k for k in texts}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in texts:
        for b in texts:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), root(k)) for k in texts}


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.integers(len(words))] = f"x{rng.integers(1000)}"
    return " ".join(words)


def test_jaccard_groups_by_brute_force(spark, documents):
    rng = np.random.default_rng(5)
    passage = [f"p{k}" for k in range(60)]
    base = [f"b{k}" for k in range(120)]
    texts = [edited(rng, base, rng.integers(0, 4)) for _ in range(60)]
    texts += [" ".join(passage + [f"o{k}_{j}" for j in range(rng.integers(3, 40))]) for k in range(40)]
    texts += [" ".join(rng.choice(WORDS[:4], rng.integers(0, 14))) for _ in range(120)]
    texts += [None, "", " \n", "One two", "one TWO", "É é", "y " * 3000, "y " * 3001]
    texts += [r["text"] for r in documents.collect()]
    expected = brute_groups(dict(enumerate(texts)))
    got = by_id(jaccard_join.similar_groups(frame(spark, texts)))
    assert {k: (r["n_shingles"], r["component_id"]) for k, r in got.items()} == expected


def test_jaccard_corner_cases(spark):
    long = " ".join(WORDS)
    rows = [(7, long), (7, long), (None, long), (None, "alone"), (3, None), (9, "alone two")]
    got = jaccard_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == {
        (7, 36, 7): 2, (None, 36, 7): 1, (None, 1, None): 1, (3, 0, 3): 1, (9, 1, 9): 1,
    }
    assert jaccard_join.similar_groups(frame(spark, [])).count() == 0


def test_sketches_never_hide_a_link():
    rng = np.random.default_rng(1)
    for _ in range(300):
        pool = rng.integers(0, 2**63, 400, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 300))) for _ in "ab")
        seen = jaccard_join.sketch_distance(*map(jaccard_join.parity_sketch, (a, b)))
        assert seen <= len(np.setxor1d(a, b))


def test_boundary_is_where_subsets_cost_more():
    assert jaccard_join.boundary_by_cost({}, 75) == 1
    assert jaccard_join.boundary_by_cost({4: 10, 100: 10}, 75) == 6
    assert jaccard_join.boundary_by_cost({100: 10}, 75) == 1


# --- 4 ------------------------------------------------------------------------


def test_exact_duplicates_and_collisions(spark):
    texts = ["Ab", "aB", "é", "É", None, "", "ab ", "z" * 200_000, "Z" * 200_000, "q"]
    expected = {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, 8: 7, 9: 9}
    for content in (exact_dedup.hash_128, lambda t: bytes([len(t) % 2])):
        got = by_id(exact_dedup.exact_duplicates(frame(spark, texts), content_hash=content))
        assert {k: r["keep_id"] for k, r in got.items()} == expected
        assert {k for k, r in got.items() if r["kept"]} == set(expected.values())
    assert got[0]["group_size"] == 2
    assert got[0]["text_sha256"] == hashlib.sha256(b"ab").hexdigest()
    rows = [(1, "a"), (1, "a"), (None, "A"), (5, "b")]
    got = exact_dedup.exact_duplicates(
        spark.createDataFrame(rows, "doc_id long, text string"), keep="largest").collect()
    assert Counter((r["doc_id"], r["keep_id"], r["kept"]) for r in got) == {
        (1, 1, True): 2, (None, 1, False): 1, (5, 5, True): 1}
    assert exact_dedup.exact_duplicates(frame(spark, [])).count() == 0


# --- 5 ------------------------------------------------------------------------


def test_packing(spark, documents, library):
    extra = spark.createDataFrame(
        [(None, "a"), (10**6, None), (10**6 + 1, ""), (10**6 + 2, "x<|endoftext|> y"),
         (10**6 + 3, "word " * 9000)], "doc_id long, text string")
    docs = documents.select("doc_id", "text").union(extra)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    pieces = defaultdict(list)
    bins = defaultdict(list)
    for r in packing.pack_documents(docs).collect():
        pieces[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(texts)
    for doc, own in pieces.items():
        ids = [*library.encode(texts[doc], add_special_tokens=False).ids, 0]
        at = 0
        for k, r in enumerate(sorted(own, key=lambda r: r["piece"])):
            part = np.array(ids[at : at + r["length"]], dtype="<u4").tobytes()
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(part))
            assert r["length"] == 2048 or k == 0
            at += r["length"]
        assert at == len(ids)
    total = 0
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
        total += at
    assert len(bins) <= total / 2048 * 1.02 + 2
    assert packing.pack_documents(docs.limit(0)).count() == 0


# --- 6 ------------------------------------------------------------------------


def brute_counts(text):
    text = text or ""
    words = text.encode().split()
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    often = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(5)}
    lines = [line for line in text.split("\n") if line.encode().split()]
    return (
        len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)), len(covered),
    )


def test_statistics_by_brute_force(spark, documents):
    texts = [r["text"] for r in documents.collect()]
    texts += [None, "", " \n\t", "a b c d e", "a " * 9, "x y z\x0bw v\nx y z w v\x1f", "é b | #" * 5,
              "\n\n a\n a\na\n", "q " * 30_000, "A1 b2 c3 d4 e5 f6 " * 3]
    got = by_id(decision_list.text_statistics(frame(spark, texts)))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for k, text in enumerate(texts):
        assert tuple(got[k][n] for n in names) == brute_counts(text), (k, text and text[:80])


def test_rules_find_junk_and_keep_clean_documents(spark):
    rng = np.random.default_rng(2)
    texts, labels = [], []
    for k in range(600):
        words = [f"{rng.choice(WORDS)}{rng.integers(10**6)}" for _ in range(rng.integers(15, 80))]
        junk = k % 6 == 0
        texts.append(" ".join(w + "###" if junk and k % 12 else w.upper() + "!!" if junk else w
                              for w in words) + ("" if k % 5 else " R&D"))
        labels.append((k, 0 if junk else 1))
    labels += [(None, 0), (10**9, 1), (3, None)]
    docs = frame(spark, [*texts, None, ""])
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    judged, rules = decision_list.judge_documents(docs, known)
    got = by_id(judged)
    assert 1 <= len(rules) <= 10
    assert all(got[k]["kept"] == bool(k % 6) for k in range(600))
    assert not got[600]["kept"] and got[600]["base_failed"]
    judged, rules = decision_list.judge_documents(docs, known.limit(0))
    assert rules == [] and all(r["kept"] != r["base_failed"] for r in judged.collect())
    assert decision_list.judge_documents(docs.limit(0), known)[0].count() == 0


# --- 7 ------------------------------------------------------------------------


def test_simhash_is_the_majority(spark):
    rng = np.random.default_rng(4)
    rows = [([int(x) for x in rng.integers(-(2**63), 2**63 - 1, n)],) for n in (0, 1, 2, 126, 127, 128, 400, 20_000)]
    rows += [([-1 - k for k in range(n)],) for n in (127, 128, 254, 16_383, 16_384)]  # high bits all set
    df = fuzzy_lines.with_simhash(spark.createDataFrame(rows, "h array<long>"), "h")
    for row in df.collect():
        bits = [2 * sum((x >> b) & 1 for x in row["h"]) > len(row["h"]) for b in range(64)]
        assert row["simhash"] % 2**64 == sum(1 << b for b in range(64) if bits[b])


def test_fuzzy_lines(spark):
    line = " ".join(f"word{k}" for k in range(60))
    near = line.replace("word59", "word5x")
    rows = [
        (1, f"Own opening line of this first document\n{line}\nshort"),
        (2, f"{line.upper()}!\nshort\nquite another line with words of its own"),
        (3, near), (4, None), (5, ""), (6, f"{line}\n{line}\nend"), (None, "short\nshort"),
        (7, "a line that nobody else has in here"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("line_no", F.lit("clash"))
    got = {r["doc_id"]: r["text"] for r in fuzzy_lines.drop_fuzzy_lines(df).collect()}
    same = spark.createDataFrame([(line, near)], "x string, y string")
    for c in ("x", "y"):
        hashes = F.transform(F.split(c, " "), lambda w: F.xxhash64(w))
        same = fuzzy_lines.with_simhash(same.withColumn("hashes", hashes)).drop("hashes")
        same = same.withColumn(c, fuzzy_lines.block_keys(F.col("simhash"))).drop("simhash")
    meets = same.select(F.arrays_overlap("x", "y")).first()[0]
    assert got == {
        1: rows[0][1], 2: "short\nquite another line with words of its own",
        3: "" if meets else near, 4: None, 5: "", 6: "end", None: "short\nshort", 7: rows[7][1],
    }
    assert fuzzy_lines.drop_fuzzy_lines(df.limit(0)).count() == 0


def edits(a, b, most):
    """Edit distance up to ``most``, else more, by diagonals."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        low, high = max(1, i - most), min(len(b), i + most)
        last, row[low - 1] = row[low - 1], i if low == 1 else most + 1
        for j in range(low, high + 1):
            last, row[j] = row[j], min(last + (x != b[j - 1]), row[j - 1] + 1, row[j] + 1)
        if high < len(b):
            row[high + 1] = most + 1
    return row[len(b)]


def brute_lines(lines):
    """The lines that stay of one to a document, by all pairs."""
    root = list(range(len(lines)))
    for b, y in enumerate(lines):
        for a in range(b):
            most = max(len(lines[a]), len(y)) // 10
            if abs(len(lines[a]) - len(y)) > most:
                continue
            i, j = a, b
            while root[i] != i:
                i = root[i]
            while root[j] != j:
                j = root[j]
            if i != j and edits(lines[a], y, most) <= most:
                root[max(i, j)] = min(i, j)
    return [k for k in range(len(lines)) if root[k] == k]


def varied(rng, kind, line):
    words = line.split()
    if kind == "word":  # one word exchanged for one as long
        k = rng.integers(len(words))
        words[k] = "".join(rng.choice(list("qxz"), min(len(words[k]), len(line) // 10)))
        return " ".join(words)
    letters = list(line)  # up to a twentieth or a tenth of the letters, anywhere
    for _ in range(max(1, len(line) // (20 if kind == "letters" else 10))):
        k = rng.integers(1, len(letters) - 1)
        if letters[k] != " ":
            letters[k : k + 1] = [[], ["q"], ["z", letters[k]]][rng.integers(3)]
    return "".join(letters)


def kept_lines(spark, lines, **choices):
    found = by_id(fuzzy_lines.drop_fuzzy_lines(frame(spark, lines), **choices))
    return [k for k in range(len(lines)) if found[k]["text"]]


def test_near_lines_by_all_pairs(spark):
    rng = np.random.default_rng(8)
    known = ["".join(rng.choice(list("aehinorst"), rng.integers(2, 9))) for _ in range(400)]
    lines = []
    for n in [5, 6, 7, 8, 9, 10, 12, 15, 20, 30, 50] * 12:
        lines.append(" ".join(rng.choice(known, n)))
        lines.append(varied(rng, "word", lines[-1]))
        if len(lines[-2]) <= fuzzy_lines.SHORT:
            lines += [varied(rng, "tenth", lines[-2]) for _ in range(3)]
    assert kept_lines(spark, lines) == brute_lines(lines)


def test_lines_of_few_words_by_all_pairs(spark):
    rng = np.random.default_rng(9)
    lines = ["all rights reserved", "all right reserved", "end", "end", "a", "a", "b", "reouha the of heble"] * 3
    for n in (9, 10, 19, 30, 50, 56, 90, 200):  # without spaces
        for _ in range(5):
            lines.append("".join(chr(0x4E00 + k) for k in rng.integers(0, 500, n)))
            for edits_made in (0, 1, n // 20):
                letters = list(lines[-1])
                for k in rng.integers(0, n, edits_made):
                    letters[k] = "\u4e0d"
                lines.append("".join(letters))
    assert kept_lines(spark, lines, least_words=1) == brute_lines(lines)
    assert kept_lines(spark, ["...", "...", "a\n-\nb", "B"], least_words=1) == [0, 1, 2]


def test_query_drops_repeated_short_lines(spark, sf, tmp_path):
    rows = [(1, "end\nfirst of all"), (2, "End!"), (3, "\u524d\u540e"), (4, "\u524d\u540e")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = by_id(QUERIES["op7_fuzzy_lines"](spark, str(tmp_path)))
    assert {k: (r["text"], r["n_removed"]) for k, r in got.items()} == {
        1: (rows[0][1], 0), 2: ("", 1), 3: (rows[2][1], 0), 4: ("", 1)}


def test_edit_similarity_with_cuts(spark):
    base = "abcdefghij" * 30
    pairs = [(base, base), (base, base[:150] + "X" * 30 + base[180:]), (base, base[:150] + "X" * 31 + base[181:]),
             (base, base + "y" * 33), (base, base + "y" * 34), ("ab", "ab"), ("", "")]
    rows = [(2 * k, 2 * k + 1, x, y) for k, (x, y) in enumerate(pairs)]
    found = fuzzy_lines.alike(spark.createDataFrame(rows, "a long, b long, x string, y string"))
    assert sorted(r["a"] // 2 for r in found.collect()) == [0, 1, 3, 5, 6]


# --- 8 ------------------------------------------------------------------------


def test_rollup_commits_once(spark, tmp_path, documents, library):
    counts = token_rollup.count_tokens(documents).withColumn("tokenizer", F.lit("v1")).cache()
    state = token_rollup.TokenRollup(spark, str(tmp_path))
    assert state.totals(["one"]).count() == 0
    assert state.commit("one", token_rollup.inserts(counts))
    assert not state.commit("one", token_rollup.inserts(counts))
    gone = counts.filter("doc_id % 2 = 0")
    changed = counts.filter("doc_id % 2 = 1").withColumns(
        {"old_tokens": F.col("n_tokens"), "n_tokens": F.col("n_tokens") * 2})
    assert state.commit("two", token_rollup.deletes(gone).union(token_rollup.revisions(changed)))
    expected = Counter()
    for r in documents.collect():
        if r["doc_id"] % 2:
            ids = library.encode(r["text"], add_special_tokens=False).ids
            expected[r["source"], r["lang"]] += 2 * len(ids)
    got = {(r["source"], r["lang"]): r["n_tokens"] for r in state.totals(["two", "one"]).collect()}
    assert got == dict(expected)
    with pytest.raises(ValueError):
        state.commit("../x", token_rollup.inserts(counts))


# --- 9 ------------------------------------------------------------------------


def test_in_domain_documents_score_lower(spark):
    rng = np.random.default_rng(3)
    near = [" ".join(rng.choice(["red", "green", "blue"], 30)) for _ in range(40)]
    far = [" ".join(rng.choice(["one", "two", "three"], 30)) for _ in range(40)]
    texts = [*near, *far, None, "", " \n", "red " * 40_000]
    target = frame(spark, ["red green blue green red blue " * 5])
    got = by_id(cross_entropy.cross_entropy_difference(frame(spark, texts), target))
    held_out = [got[k]["difference"] for k in range(40)], [got[k]["difference"] for k in range(40, 80)]
    assert max(held_out[0]) < min(held_out[1])
    assert all(got[k]["difference"] is None and got[k]["n_words"] == 0 for k in (80, 81, 82))
    assert got[83]["n_words"] == 40_000
    assert cross_entropy.cross_entropy_difference(frame(spark, []), target).count() == 0
    empty = cross_entropy.cross_entropy_difference(frame(spark, near), target.limit(0))
    assert all(r["loss_target"] == pytest.approx(cross_entropy.WORD_BITS * np.log(2)) for r in empty.collect())


def brute_losses(texts, target):
    lists = [[exact_dedup.lower_ascii((t or "").encode()).split() for t in x] for x in (target, texts)]
    once = [Counter(w for t in x for w in t) for x in lists]
    twice = [Counter(p for t in x for p in zip(t, t[1:])) for x in lists]
    vocabulary = max(1 << cross_entropy.WORD_BITS, len(once[0] | once[1]))
    totals = [sum(x.values()) for x in once]

    def loss(m, before, word):
        p = (once[m][word] + 1) / (totals[m] + vocabulary)
        if before is not None and once[m][before]:
            weight = cross_entropy.PAIR_WEIGHT
            p = weight * twice[m][before, word] / once[m][before] + (1 - weight) * p
        return -np.log(p)

    return [
        [np.mean([loss(m, *p) for p in zip([None, *t], t)]) if t else None for m in (0, 1)]
        for t in lists[1]
    ]


@pytest.mark.parametrize("head, words", [(0, 10**6), (100, 50), (10**6, 0)])
def test_losses_of_many_words_by_brute_force(spark, monkeypatch, head, words):
    monkeypatch.setattr(cross_entropy, "HEAD_PAIRS", head)
    monkeypatch.setattr(cross_entropy, "HEAD_WORDS", words)
    monkeypatch.setattr(cross_entropy, "AT_ONCE", 50_000)
    rng = np.random.default_rng(4)
    texts = [" ".join(f"n{k}" for k in rng.integers(0, 600_000, 20_000)) for _ in range(20)]
    texts += [" ".join(rng.choice(WORDS, rng.integers(1, 60))) for _ in range(200)]
    texts += [None, "", " \n", "One", "one one ONE", texts[0]]
    target = [texts[0], " ".join(f"n{k}" for k in range(1000)), "other words here", None]
    got = by_id(cross_entropy.cross_entropy_difference(frame(spark, texts), frame(spark, target)))
    for k, (t, b) in enumerate(brute_losses(texts, target)):
        found = got[k]["loss_target"], got[k]["loss_background"]
        assert found == ((None, None) if t is None else pytest.approx((t, b), abs=1e-9)), k
    assert len(got) == len(texts)


# --- 10 -----------------------------------------------------------------------


def test_bpe_round_trip(spark, documents, library):
    rng = np.random.default_rng(7)
    letters = list(" \n\t\r\x1c\x85 　'aehst<|>1²½éß中\U0001f600,.!?#_-")
    texts = ["".join(rng.choice(letters, rng.integers(0, 50))) for _ in range(800)]
    texts += [None, "", " ", "  a  b ", "x<|endoftext|> y", "it's we'll don't''re", "a" * 30_000]
    texts += [r["text"] for r in documents.collect()]
    got = by_id(bpe_automaton.bpe_round_trip(frame(spark, texts)))
    for k, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[k]["ids"] == ",".join(map(str, ids)) and got[k]["n_tokens"] == len(ids)
        assert got[k]["decoded"] == library.decode(ids, skip_special_tokens=False)
    encoded = bpe_automaton.bpe_encode(frame(spark, texts[-20:]))
    decoded = by_id(bpe_automaton.bpe_decode(encoded))
    assert [decoded[k]["decoded"] for k in range(20)] == texts[-20:]
    assert bpe_automaton.bpe_round_trip(frame(spark, [])).count() == 0


def test_automaton_accepts_what_merges_give():
    rng = np.random.default_rng(9)
    for _ in range(30):
        numbers = {b"a": 0, b"b": 1}
        merges = []
        for _ in range(8):
            u, v = (list(numbers)[k] for k in rng.integers(0, len(numbers), 2))
            if u + v not in numbers:
                numbers[u + v] = len(numbers)
                merges.append((u, v))
        automaton = bpe_automaton.MergeAutomaton(numbers, merges)
        for _ in range(30):
            word = bytes(rng.choice([97, 98], rng.integers(1, 20)).tolist())
            parts = [word[k : k + 1] for k in range(len(word))]
            for u, v in merges:
                out, k = [], 0
                while k < len(parts):
                    if parts[k : k + 2] == [u, v]:
                        out.append(u + v)
                        k += 2
                    else:
                        out.append(parts[k])
                        k += 1
                parts = out
            assert automaton.decode(automaton.encode(word)) == word
            assert [automaton.label[t] for t in automaton.encode(word)] == parts
