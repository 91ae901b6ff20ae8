"""Each operator's query columns against a plain restatement, over odd rows: nulls, empty and long texts, copies."""

import random
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

from lodeseam.llm import (
    chat_format,
    decontaminate,
    license_scan,
    mixing,
    quality_rules,
    sharding,
    simhash_dedup,
    substring_dedup,
    token_output,
    url_filters,
)

RNG = random.Random(11)
VOCABULARY = ["the", "of", "and", "Über", "l'été", "x", "data", "model,", "river.", "ß", "naïve", "42", "3rd", "--", "end"] + [f"w{k}" for k in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) + r.choice(["", "", "", ".\n", "\t"]) for _ in range(n))


PASSAGE, ITEM = prose(60, 1), prose(30, 2)
LICENSES = ["Released under the MIT License.", "under  the mit\nlicense", "x Licensed under the Apache License, Version 2.0. CC BY-NC cc by nc", "mit license the under"]
TEXTS = [
    None, "", " \n\t ", "one", "two words", "a\x0bb\x0cc\rd", "É x y", prose(80, 3), prose(80, 3), prose(80, 3) + " tail",
    prose(200, 4) + PASSAGE + prose(50, 5), PASSAGE + " " + PASSAGE, prose(40, 6) + " " + PASSAGE, ITEM, prose(900, 7) + " " + ITEM, "say " * 120,
    prose(34, 8), prose(35, 9), prose(35, 9), prose(20_000, 10), "#*$%&|<> " * 30, *LICENSES, "x <|endoftext|> y<|startoftext|>z", "\n".join(["same line here"] * 30),
    *(prose(60, 100 + k) for k in range(20)),
]
DOCS = [(k if k != 7 else None, t, "en", ["a", "b", None, "é"][k % 4], 0) for k, t in enumerate(TEXTS)]
DOCS += [DOCS[9], DOCS[9], (None, None, None, None, None), (5, prose(70, 77), "en", "a", 1)]
PAIRS = [(d[0], d[1]) for d in DOCS]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA)


@pytest.fixture(scope="module")
def clash(docs):
    """The same rows with columns named like the operators' own."""
    names = (
        "rid", "id", "row", "anchor", "fp", "size", "key", "bucket", "target", "shard", "slot", "n_words", "spans", "items", "kept", "tie", "text_key",
        "_spans", "_items", "_n_words", "_key", "_k", "_n", "_rows", "_epochs", "_at", "at", "n", "ids", "seen", "times", "row_key", "mark", "parts",
        "_strings", "_counts", "first", "least", "other", "node", "root", "full", "more", "j", "s", "b", "words", "record", "_parts", "_fingerprint", "entry", "day", "place",
    )
    return docs.select("*", *(F.lit(-1).alias(n) for n in names))


def got(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def both(docs, clash, f, *columns):
    a, b = got(f(docs), *columns), got(f(clash), *columns)
    assert a == b
    empty = f(docs.limit(0))
    assert empty.count() == 0 and set(columns) <= set(empty.columns)
    return a


def test_simhash(docs, clash):
    import numpy as np

    found = both(docs, clash, simhash_dedup.near_duplicates, "doc_id", "fingerprint", "component_id")
    assert found == brute.simhash(PAIRS)
    kept = simhash_dedup.dedup(docs)
    assert kept.columns == docs.columns
    prints = np.unique(np.array([int(f, 16) for _, f, _ in brute.simhash(PAIRS)], np.uint64))
    i, j = np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3)
    assert kept.count() == len(np.unique(_linked(prints, prints[i], prints[j])))
    other = simhash_dedup.dedup(clash)
    assert other.columns == clash.columns and got(other, "doc_id", "text") == got(kept, "doc_id", "text")


def test_simhash_keeps_rows_not_ids(spark):
    """A copy that shares its doc_id with a text of its own: the copy goes, the other text stays."""
    a, u = prose(60, 1), prose(60, 2)
    docs = spark.createDataFrame([(1, a), (5, a), (5, u), (None, a), (None, u)], "doc_id long, text string")
    assert got(simhash_dedup.dedup(docs), "doc_id", "text") == Counter([(1, a), (5, u)])


def _linked(keys, x, y):
    import numpy as np

    forest = simhash_dedup.Forest(len(keys))
    forest.add(np.searchsorted(keys, x), np.searchsorted(keys, y))
    return forest.find(np.arange(len(keys)))


def _fingerprints(n=60):
    """Distinct fingerprints with neighbours of one to three bits, and each one's component by all pairs."""
    import numpy as np

    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, n, dtype=np.uint64)
    flip = lambda x: x ^ (np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64))
    keys = np.unique(np.concatenate([base, *(flip(base) for _ in range(3)), flip(flip(flip(base))), flip(flip(flip(flip(base)))), np.arange(9, dtype=np.uint64)]))
    i, j = np.nonzero(np.triu(np.bitwise_count(keys[:, None] ^ keys[None, :]) <= 3, 1))
    return keys, _linked(keys, keys[i], keys[j])


def test_trie_against_all_pairs():
    keys, want = _fingerprints()
    assert (_linked(keys, *simhash_dedup.trie_links(keys, 3)) == want).all()


@pytest.mark.parametrize("most", [1 << 20, 4, 0])
def test_dealt_trie_against_all_pairs(spark, most):
    """The same by leading blocks, none, some and all of them parted once more."""
    import numpy as np

    keys, want = _fingerprints()
    rows = spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "fp long")
    edges = np.array([tuple(r) for r in simhash_dedup.links(rows, 3, most).collect()], np.int64).view(np.uint64)
    assert (_linked(keys, edges[:, 0], edges[:, 1]) == want).all()


def test_components(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 101), (200, 100), (300, 300)] + [(500, 400 + k) for k in range(30)]
    found = dict(map(tuple, simhash_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(found[k] == 0 for k in range(61)) and found[200] == found[101] == 100 and found[429] == 400 and 300 not in found


def test_tokens(spark, docs, tmp_path):
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):  # by words, and by whole texts
        path, at = public_tokenizers.path(name), f"file://{tmp_path}/{name}"
        own = Tokenizer.from_file(path)
        assert token_output.Encoder(path).by_word == name.startswith("word")
        token_output.write(docs, path, at, shard=20_000)
        rows = token_output.read(spark, at).collect()
        assert sorted(r.start for r in rows)[0] == 0 and len(rows) == len(DOCS)
        ordered = sorted(rows, key=lambda r: r.start)
        assert [r.doc_id for r in ordered] == sorted((d for d, _ in PAIRS), key=lambda d: (d is not None, d or 0))
        assert all(a.start + a.n_tokens == b.start for a, b in zip(ordered, ordered[1:]))
        want = Counter((d, zlib.crc32(np.array([*own.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())) for d, t in PAIRS)
        assert Counter((r.doc_id, zlib.crc32(bytes(r.ids))) for r in rows) == want
    at = f"file://{tmp_path}/none"
    token_output.write(docs.limit(0), path, at)
    assert token_output.checksums(token_output.read(spark, at)).count() == 0


def test_tokens_of_odd_words():
    import pyarrow as pa
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own, encoder = Tokenizer.from_file(path), token_output.Encoder(path)
    texts = ["ÀÉ! don't,, it's <|endoftext|>x a<|startoftext|>", "\u212aelvin \u0130x \u1e9e e\u0301a ÷×", "a\u00a0b c\u2003d 12.5% x_y'z ...", "Ωμέγα, 日本語。 n\u0303"]
    texts += ["".join(random.Random(k).choices("aZé'Ü.,<|>9 \n\t\u0301\u00a0ß_$", k=60)) for k in range(400)]
    ids, counts = encoder.ids(pa.array([*texts, None]))
    want = [own.encode(t, add_special_tokens=False).ids for t in [*texts, ""]]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


def test_tokens_of_one_doc_id(spark, tmp_path):
    import public_tokenizers

    rows = [(7 if k % 3 else k, "one text" if k % 2 else f"text {k}") for k in range(3000)]
    docs, at = spark.createDataFrame(rows, "doc_id long, text string"), f"file://{tmp_path}/hot"
    token_output.write(docs, public_tokenizers.path("word_bpe_49k.json"), at, shard=1500)
    found = token_output.read(spark, at).collect()
    ordered = sorted(found, key=lambda r: r.start)
    assert len(found) == 3000 and [r.doc_id for r in ordered] == sorted(d for d, _ in rows)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(ordered, ordered[1:]))
    sizes = [p.stat().st_size for p in (tmp_path / "hot").glob("*.tok")]
    assert len(sizes) > 6 and max(sizes) < 4 * sum(sizes) / len(sizes)


def test_token_coding():
    import numpy as np

    rng = np.random.default_rng(5)
    for counts in ([0], [1, 0, 5, 4], [3, 3, 1000]):
        counts = np.array(counts)
        numbers = np.where(rng.random(counts.sum()) < 0.5, rng.integers(0, 300, counts.sum()), rng.integers(0, 2**32, counts.sum())).astype(np.uint32)
        control, data, n_control, n_data = token_output.encode(numbers, counts)
        assert len(control) == n_control.sum() and len(data) == n_data.sum()
        assert (token_output.decode(control, data, counts) == numbers).all()


def test_licenses(docs, clash):
    found = both(docs, clash, license_scan.scan, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert found == Counter((d, *brute.base_licenses(t)) for d, t in PAIRS)
    own = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    for r in own.values():
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_license_join_finds_every_block(docs):
    """Labels and scores by comparing every line with every template."""
    best = {}
    for d, t in PAIRS:
        for line in (t or "").split("\n"):
            words = set(brute.ALNUM.findall(brute.lower(line)))
            for label, template in license_scan.TEMPLATES:
                own = license_scan.template_words(template)
                part = len(words & own) / len(own)
                if part >= license_scan.THRESHOLD - 1e-12:
                    labels, score = best.get((d, t), (set(), 0))
                    best[d, t] = labels | {label}, max(score, part)
    want = Counter()
    for d, t in PAIRS:
        labels, score = best.get((d, t), (set(), 0.0))
        labels = labels | set(filter(None, brute.base_licenses(t)[-1].split(",")))
        want[d, ",".join(sorted(labels)), round(score, 9)] += 1
    assert Counter((r.doc_id, r.labels, round(r.score, 9)) for r in license_scan.scan(docs).collect()) == want
    assert best


def test_decontamination(spark, docs, clash):
    items = [(1, ITEM), (2, PASSAGE), (3, None), (4, ""), (5, "two words"), (None, prose(20, 4)), (6, ITEM), (7, "--")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    found = both(docs, clash, lambda d: decontaminate.report(d, benchmark), *columns)
    assert found == brute.contaminated(PAIRS, items)
    assert got(decontaminate.report(docs, benchmark.limit(0)), *columns) == brute.contaminated(PAIRS, [])
    cleaned = decontaminate.clean(docs, benchmark)
    assert cleaned.columns == docs.columns
    other = decontaminate.clean(clash, benchmark)
    assert other.columns == clash.columns and got(other, *docs.columns) == got(cleaned, *docs.columns)
    assert {r["_spans"] for r in other.collect()} == {-1}
    bad = {d for d, *_, c in brute.contaminated(PAIRS, items) if c}
    left = {r.doc_id: r.text for r in cleaned.collect()}
    assert 14 in left and ITEM not in left[14] and not bad & (set(left) - {5})
    again = decontaminate.report(cleaned, benchmark).filter("contaminated").count()
    assert again == 0


def test_decontamination_in_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 100)
    items = [(1, ITEM), (2, PASSAGE), (5, "two words"), (6, ITEM)]
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    found = got(decontaminate.report(docs, spark.createDataFrame(items, "item_id long, text string")), *columns)
    assert found == brute.contaminated(PAIRS, items)


def test_fm_index():
    import numpy as np

    rng = np.random.default_rng(7)
    for n, symbols in ((1, 2), (50, 3), (400, 2), (3000, 9)):
        s = rng.integers(0, symbols, n)
        s[-1] = 0
        index = decontaminate.FMIndex(s, symbols)
        has_pair = np.zeros(1 << 22, bool)
        has_pair[decontaminate._pairs_of(s[:-1], s[1:])] = True
        for length in (1, 2, 4, 7):
            patterns = rng.integers(1, symbols, (20, length))
            trie = decontaminate.Reversed(patterns, np.arange(20))
            windows, lo, hi = trie.search(index, has_pair)
            found = {w: sorted(index.locate(np.arange(a, b)).tolist()) for w, a, b in zip(windows.tolist(), lo, hi)}
            assert sorted(k for w in range(len(trie.rows)) for k in trie.owners[trie.first[w] : trie.first[w + 1]]) == list(range(20))
            for w, p in enumerate(trie.rows):
                assert all((patterns[k] == p).all() for k in trie.owners[trie.first[w] : trie.first[w + 1]])
                where = [k for k in range(n - length + 1) if (s[k : k + length] == p).all()]
                assert found.get(w, []) == where


def test_quality(spark, docs, clash):
    labels = spark.createDataFrame([(d, int("#" not in (t or "#")), 0) for d, t in PAIRS if d is not None], "doc_id long, quality int, toxic int")
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    found = both(docs, clash, lambda d: quality_rules.judge(d, labels), *columns)
    assert found == Counter((d, *brute.quality(t)) for d, t in PAIRS)
    judged = quality_rules.judge(docs, labels.limit(0)).collect()
    assert all(r.kept != r.base_failed for r in judged)
    kept = quality_rules.keep(docs, labels.limit(0))
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in judged if r.kept)
    assert quality_rules.keep(clash, labels).columns == clash.columns


def test_decision_list_on_held_out_rows():
    import numpy as np

    rng = np.random.default_rng(9)
    x = {k: rng.random(4000) for k in quality_rules.RATIOS}
    bad = ((x["symbol_part"] > 0.8) & (x["mean_word"] < 0.6)) | (x["repeat_part"] > 0.9)
    noisy = bad ^ (rng.random(4000) < 0.01)
    rules = quality_rules.learn({k: v[:2000] for k, v in x.items()}, noisy[:2000])
    test = {k: v[2000:] for k, v in x.items()}
    found = np.any([quality_rules.covers(r, test, 2000) for r in rules], axis=0)
    assert (found == bad[2000:]).mean() > 0.97 and len(rules) <= 6
    assert quality_rules.learn(x, np.zeros(4000, bool)) == []
    chance = quality_rules.learn(x, rng.random(4000) < 0.3)
    assert np.sum([quality_rules.covers(r, x, 4000).sum() for r in chance]) < 40  # nothing to be learned from chance


def test_substrings(docs, clash):
    found = both(docs, clash, lambda d: substring_dedup.dedup(d).withColumn("sha", F.sha2(F.col("kept_text").cast("binary"), 256)), "doc_id", "n_words", "n_removed", "sha")
    assert found == brute.substrings(PAIRS)
    assert substring_dedup.lengths() == [9, 18]
    levels = []
    substring_dedup.dedup(docs, survivors=levels)
    assert [n for n, _ in levels] == [9, 18] and levels[0][1] >= levels[1][1] > 0
    levels = []
    alone = substring_dedup.dedup(docs.filter("doc_id IN (0, 1)"), survivors=levels)
    assert levels == [(9, 0)] and alone.agg(F.sum("n_removed")).first()[0] == 0  # no candidate survives the first level
    for window in (5, 8, 40, 70):
        own = substring_dedup.dedup(docs, window).withColumn("sha", F.sha2(F.col("kept_text").cast("binary"), 256))
        assert got(own, "doc_id", "n_words", "n_removed", "sha") == brute.substrings(PAIRS, window)


def test_mixing(docs, clash):
    columns = ("doc_id", "source", "size", "source_size", "target", "taken", "epochs")
    found = both(docs, clash, mixing.plan, *columns)
    sizes = Counter()
    for d, t, _, s, _ in DOCS:
        sizes[s] += len(brute.WS.findall(t or ""))
    want = brute.targets(sizes)
    taken, largest = Counter(), Counter()
    for (_, source, size, source_size, target, n, epochs), k in found.items():
        assert source_size == sizes[source] and abs(target - want[source]) < 1e-6 and n == size * epochs and n <= 2 * size
        taken[source] += n * k
        largest[source] = max(largest[source], size)
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    other = mixing.mix(clash)
    assert other.columns == clash.columns and {r["_key"] for r in other.collect()} == {-1}
    assert mixing.mix(docs.limit(0)).count() == 0
    assert Counter(r.source for r in mixed.collect()) == Counter({s: n for s, n in ((s, sum(k * r[6] for r, k in found.items() if r[1] == s)) for s in sizes) if n})


def test_targets_refill_until_none_is_above(spark):
    for seed in range(4):
        r = random.Random(seed)
        sizes = {**{f"s{k}": r.choice([0, 1, 5, 100, 10_000]) for k in range(12)}, None: 7}
        rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        found = {x.source: x.target for x in mixing.targets(rows).collect()}
        assert all(abs(found[s] - t) < 1e-6 * max(1, t) for s, t in brute.targets(sizes).items())


def test_sharding(docs, clash):
    found = both(docs, clash, lambda d: sharding.place(d, 8), "doc_id", "text", "size", "text_crc32", "row_number", "shard", "slot")
    assert Counter((r[0], r[2], r[3]) for r in found) == brute.sizes(PAIRS)
    n = len(DOCS)
    for r in found:
        assert sharding.locate(r[4], n, 8) == (r[5], r[6]) and sharding.occupant(r[5], r[6], n, 8) == r[4]
    for shard in range(8):
        slots = sorted(r[6] for r in found if r[5] == shard)
        assert slots == list(range(len(slots))) and n // 8 <= len(slots) <= n // 8 + 1


def test_permutation():
    import numpy as np

    for n in (1, 2, 3, 7, 64, 65, 1000, 70_000):
        places = sharding.permute(np.arange(n), n)
        assert (np.sort(places) == np.arange(n)).all() and (sharding.permute(places, n, backward=True) == np.arange(n)).all()
    assert (sharding.permute(np.arange(1000), 1000, seed=1) != sharding.permute(np.arange(1000), 1000, seed=2)).any()


def test_chat(spark):
    own = "\\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", own), (-7, 1, "assistant", own), (1, 2, "assistant", None), (1, 1, None, "\\s\\\\l"), (1, 0, "a: ###", "</turn>\n### x: y"), (2, 0, "system", "s"), (2, 1, "user", ""), (2, 2, "assistant", "é 🎈")]
    rows += [(3, 0, "user", "q"), (3, 0, "user", "q"), (3, 1, "human", "h"), (None, 0, "user", "n"), (4, None, "assistant", "x"), (4, 0, "assistant", "y"), (5, 0, "system", ""), (5, 1, "user", "u"), (5, 2, "assistant", "v")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = chat_format.digest(chat_format.formatted(chat_format.canonical(chat_format.records(turns))))
    assert got(found, "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == brute.chats(rows)
    assert {r.layout for r in found.collect()} == {"prompt", "system_prompt", "messages"}
    assert chat_format.digest(chat_format.formatted(chat_format.canonical(chat_format.records(turns.limit(0))))).count() == 0


def test_chat_layouts(spark):
    records = [
        '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}', '{"conversations":[{"value":"q","from":"human"},{"from":"gpt","value":"a"}]}',
        '{"response":"a","prompt":"q"}', '{"instruction":"q","input":"","output":"a"}', '{"instruction":"q","output":"a"}', '{"data":{"question":"q","answer":"a"}}',
        '{"prompt":"q","completion":"a"}', '{"dialog":{"turns":[{"speaker":"human","text":"q"},{"speaker":"bot","text":"a"}]}}', '{"other":1}', "no json", None, '{"prompt":null,"response":"a"}', '{"messages":[]}',
    ]
    rows = chat_format.canonical(spark.createDataFrame([(k, r) for k, r in enumerate(records)], "k long, record string")).orderBy("k").collect()
    assert all([tuple(t) for t in r.turns] == [("user", "q"), ("assistant", "a")] for r in rows[:8])
    assert all(r.turns is None and r.layout is None for r in rows[8:11])
    assert [tuple(t) for t in rows[11].turns] == [("user", ""), ("assistant", "a")] and rows[12].turns == []


def test_url_filters(spark):
    from datetime import date

    entries = [("Bad.example", "block", "2024-01-10"), ("bad.example", "allow", "2024-02-01"), ("sub.bad.example", "block", "2024-01-20"), ("bad.example", "allow", "2024-02-01"), (None, "block", "2024-01-01"), ("x.example", None, "2024-01-01")]
    urls = ["http://bad.example/a", "https://user@A.SUB.bad.example:80/x?y", "ftp://notbad.example", "bad.example", None, "http://", "http://bad.example./"]
    days = [date(2024, 1, 9), date(2024, 1, 10), date(2024, 1, 31), date(2024, 2, 1), None]
    captures = [(k, u, d, "h") for k, (u, d) in enumerate([(u, d) for u in urls for d in days] * 2)]
    found = url_filters.apply(spark.createDataFrame(captures, "page_id long, url string, fetched date, host string"), spark.createDataFrame(entries, "domain string, action string, since string"))
    got_rows = {r.page_id: (r.host, r.domain, r.action, r.blocked) for r in found.collect()}
    hosts = ["bad.example", "a.sub.bad.example", "notbad.example", None, None, None, "bad.example"]
    for k, u, d, _ in captures:
        host, best = hosts[urls.index(u)], (None, None)
        for domain, action, since in sorted((e for e in entries if None not in e), key=lambda e: (len(e[0]), e[2])):
            if host and d and (host == domain.lower() or host.endswith("." + domain.lower())) and date.fromisoformat(since) <= d:
                best = domain.lower(), action
        assert got_rows[k] == (host, *best, best[1] == "block"), (u, d)


def test_pipeline(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    first = corpus_pipeline.run(spark, small).select("doc_id", "shard", "slot", "text_crc32").collect()
    again = corpus_pipeline.run(spark, small).select("doc_id", "shard", "slot", "text_crc32").collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again)) and {r.doc_id for r in first} <= {r.doc_id for r in docs.select("doc_id").collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).columns == docs.columns
        assert stage(spark, docs.limit(0), small).count() == 0
