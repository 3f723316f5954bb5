"""Encoding, leakage and wrong decodings."""

import random

import pytest

from vantora.llm import leakage, mojibake, tokens

DOC = "doc_id long, text string, lang string, ids int, item_id int"
ITEM = "item_id long, suite string, question string, answer string, text string"
ODD = ["", None, " ", "<|endoftext|> it's  we'll\n\n \tx", "naïve ½ 価格フィールド 👩‍🔧 é", "a" * 3000, " " * 500 + "x", "\u0000�﻿", "1234567890" * 30, "don't DON'T 'tis", "--" * 700 + "=" * 90, "\r\n\r\n  　  end "]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", 0, 0) for i, t in enumerate(texts)], DOC)


def test_encoding_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(tokens.VOCABULARY.replace(".tiktoken", ".json"))
    lib.encode_special_tokens = True
    rng = random.Random(0)
    alphabet = "etaoin shrdlu ETAO '.,-_/0123456789äßéñ价格фыва\n\t😀"
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randrange(200))) for _ in range(300)]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    got = {r.doc_id: r.ids for r in tokens.encode(docs(spark, texts)).collect()}
    want = {i: e.ids for i, e in enumerate(lib.encode_batch([t or "" for t in texts], add_special_tokens=False))}
    assert got == want
    assert tokens.encode(docs(spark, [])).collect() == []


def test_trie_shares_prefixes_and_may_be_cleared():
    trie = tokens.trie_of(tokens.read_vocabulary(tokens.VOCABULARY))
    trie.clear()
    first = trie.encode(" interesting")
    nodes = len(trie.last)
    assert trie.encode(" interested") and len(trie.last) < nodes + len(" interested")
    trie.clear()
    assert trie.encode(" interesting") == first


WORDS = [f"w{i}" for i in range(400)]


def leak_cases():
    rng = random.Random(1)
    q = [" ".join(rng.sample(WORDS, 20)).capitalize() + "?" for _ in range(4)]
    a = ["Straße " + " ".join(rng.sample(WORDS, 14)) for _ in range(4)]
    w = q[0].rstrip("?").split()
    texts = [
        "x " + " ".join(w[3:15]) + " y",  # twelve words
        "x " + " ".join(w[3:14]) + " y",  # eleven
        "x " + " ".join(w[3:9]) + " oops " + " ".join(w[9:20]),  # broken
        ("_-​".join(w[:13])).upper(),  # other layout
        a[1].upper().replace("STRASSE", "STRASSE") + " tail",
        " ".join(w[:12]) + " and " + a[2],  # two items
        None, "", " ".join(WORDS), "é" * 20, " ".join(rng.choices(WORDS, k=30_000)) + " " + q[3],
    ]
    items = [(i, "s", q[i], a[i], "t") for i in range(4)] + [(9, "s", q[0], None, "t"), (None, "s", q[0], None, "t"), (10, "s", None, "short", "t")]
    return texts, items


def brute_leaks(texts, items, n=12):
    out = set()
    for d, t in enumerate(texts):
        w = leakage.words(t or "")
        runs = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for i, _, q, a, _ in items:
            for p in (q, a):
                v = leakage.words(p or "")
                if i is not None and any(tuple(v[j : j + n]) in runs for j in range(len(v) - n + 1)):
                    out.add((d, i))
    return out


@pytest.mark.parametrize("item_windows", [leakage.ITEM_WINDOWS, 100])
def test_leaks(spark, item_windows):
    texts, items = leak_cases()
    found = leakage.leaks(docs(spark, texts), spark.createDataFrame(items, ITEM), item_windows=item_windows).collect()
    got = {(r.doc_id, r.item_id) for r in found if r.exact}
    assert got == brute_leaks(texts, items)
    assert {(0, 0), (0, 9), (3, 0), (4, 1), (5, 0), (5, 2), (10, 3)} <= got and not any(d in (1, 2) for d, _ in got)


def test_edited_items_are_found_by_windows_of_their_size(spark):
    """All windows of an item's size with a similarity of 0.8 or more, whichever word was edited."""
    import numpy as np

    rng = random.Random(3)
    items, texts = [], []
    for i in range(40):
        w = rng.choices(WORDS, k=rng.choice([44, 60, 61, 90]))
        items.append((i, "s", None, " ".join(w), "t"))
        for at in rng.sample(range(len(w)), rng.choice([1, 1, 2])):
            w[at] = "edited"
        texts.append(" ".join(rng.choices(WORDS, k=9) + w + rng.choices(WORDS, k=30)))
    want = {}
    for d, t in enumerate(texts):
        words = leakage.words(t)
        for i, _, _, a, _ in items:
            v = leakage.words(a)
            runs = [words[j : j + len(v)] for j in range(len(words) - len(v) + 1)]
            if runs:
                h, n = (np.array([[f(x) for x in r] for r in [v, *runs]]) for f in (lambda x: np.uint64(leakage.xxhash.xxh3_64_intdigest(x.encode())), len))
                best = leakage.weighted_similarity(h[1:], np.repeat(h[:1], len(runs), 0), n[1:], np.repeat(n[:1], len(runs), 0)).max()
                if best >= leakage.SIMILAR:
                    want[d, i] = best
    # with exact passages of 44 words only
    got = {(r.doc_id, r.item_id): r.similarity for r in leakage.leaks(docs(spark, texts), spark.createDataFrame(items, ITEM), window=44).collect() if not r.exact}
    assert len(want) >= 15 and len(got) >= 5 and got == pytest.approx({k: v for k, v in want.items() if k in got})
    every = {(r.doc_id, r.item_id) for r in leakage.leaks(docs(spark, texts), spark.createDataFrame(items, ITEM), window=44).collect()}
    assert want.keys() <= every


def test_similar_windows_equal_brute_force(spark):
    import numpy as np

    rng = random.Random(7)
    items, texts = [], []
    for i in range(60):
        w = [rng.choice(WORDS) + str(rng.randrange(9)) * rng.choice([1, 9]) for _ in range(12)]
        w[0], w[-1] = rng.choice("abcd"), rng.choice("abcd")
        items.append((i, "s", " ".join(w), None, "t"))
        w[rng.choice([0, 11, 11, 5])] = rng.choice("efg")
        texts.append(" ".join(rng.choices(WORDS, k=9) + w + rng.choices(WORDS, k=9)))

    def windows(text):
        w = leakage.words(text)
        at = range(len(w) - 11)
        return [np.array([[leakage.xxhash.xxh3_64_intdigest(x.encode()) for x in w[i : i + 12]] for i in at], np.uint64), np.array([[len(x) for x in w[i : i + 12]] for i in at])]

    want = {}
    for d, t in enumerate(texts):
        a, wa = windows(t)
        for i, _, q, _, _ in items:
            b, wb = windows(q)
            best = leakage.weighted_similarity(a, np.repeat(b, len(a), 0), wa, np.repeat(wb, len(a), 0)).max()
            if best >= leakage.SIMILAR:
                want[d, i] = best
    found = leakage.leaks(docs(spark, texts), spark.createDataFrame(items, ITEM)).collect()
    got = {(r.doc_id, r.item_id): r.similarity for r in found}
    assert len(want) >= 20 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_leaks_of_the_test_tables(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    e = spark.read.parquet("/root/testdata/sf0.001/eval_items.parquet")
    texts, ids = zip(*[(r.text, r.doc_id) for r in d.collect()])
    items = [(r.item_id, "", r.question, r.answer, "") for r in e.collect()]
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(d, e).where("exact").collect()}
    assert got == {(ids[i], j) for i, j in brute_leaks(texts, items)} and got


def test_no_leaks_of_nothing(spark):
    texts, items = leak_cases()
    assert leakage.leaks(docs(spark, texts), spark.createDataFrame([], ITEM)).collect() == []
    assert leakage.leaks(docs(spark, []), spark.createDataFrame(items, ITEM)).collect() == []


def test_every_fingerprint_within_the_radius_is_found():
    import numpy as np

    rng = np.random.default_rng(0)
    index = leakage.ItemIndex([(1, " ".join(rng.choice(WORDS, 200)))])
    for bits in range(4):
        flips = np.array([sum(1 << int(b) for b in rng.choice(64, bits, replace=False)) for _ in index.prints], np.uint64)
        at, other = index.candidates(index.prints ^ flips, 3)
        assert {(i, i) for i in range(len(index.prints))} <= set(zip(at.tolist(), other.tolist()))


def test_fingerprints_by_both_ways():
    import numpy as np

    h = np.random.default_rng(2).integers(0, 1 << 63, 400).astype(np.uint64)
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
    for window in (1, 2, 3, 12, 13, 40, 300):
        want = np.packbits(np.array([2 * bits[i : i + window].sum(axis=0, dtype=int) > window for i in range(400 - window + 1)]), axis=1).view(np.uint64).ravel()
        assert (leakage.fingerprints(h, window) == want).all() and (leakage.fingerprints(h, window, leakage.bit_sums(h)) == want).all()


CLEAN = ["Le café est à côté, même l’été — 5 € déjà payés.", "Die Straße läuft größer für Größe über Käufer zurück.", "Você também não está em ação, é só amanhã.", "Покупатель доволен, но журнал записи показал цену.", "¿Por qué la señal está aquí? El niño comió jamón mañana.", "“Soft,” wrote a buyer, it’s naïve – 7 °C ±3", "価格フィールドの件数は24件ですが、昨日より少なくなっています。", "½ × ¾ © ® ™ and ∑ ≈ √π", "plain ascii only"]


def test_wrong_decodings_are_found_and_undone(spark):
    damage = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp1251"), ("cp1252", "mac_roman"), ("cp1252", "cp437")]
    texts, want, truth = [], set(), {}
    for i in range(25):
        texts += [t.replace("5 €", f"{i} €") for t in CLEAN]
    texts += [None, "", " ", "﻿", "x" * 200_000]
    for t in CLEAN[:3] + CLEAN[4:6]:
        for written, read in damage:
            data = t.encode(written, "ignore")
            try:
                bad = data.decode(read)
            except UnicodeDecodeError:
                continue
            want.add(len(texts))
            truth[len(texts)] = data.decode(written)
            texts.append("A line before. " + bad)
            truth[len(texts) - 1] = "A line before. " + truth[len(texts) - 1]
    want.add(len(texts))
    texts.append(CLEAN[0].encode("utf-8").decode("latin-1").encode("utf-8").decode("latin-1"))
    want.add(len(texts))
    texts.append("Le caf� est là")
    truth[len(texts) - 1] = "Le café est là"
    df = docs(spark, texts)
    assert {r.doc_id for r in mojibake.damaged_texts(df).collect()} == want
    back = {r.doc_id: r.restored for r in mojibake.restored_texts(df).collect()}
    assert sum(back[i] == t for i, t in truth.items()) >= 0.9 * len(truth)


def test_lost_bytes_are_found_without_a_replacement_character(spark):
    """A byte that was dropped, or became a blank or question mark: only the lattice's wildcards read such texts."""
    texts = []
    for i in range(25):
        texts += [t.replace("5 €", f"{i} €") for t in CLEAN]
    lost = {
        "Le café est Ã\xa0 côté": "Le café est à côté", "Le café est Ã  côté": "Le café est à côté", "Die Stra�e läuft": "Die Straße läuft",
        "Покупатель доволен, но журнал Ð·апР¸си": None, "El niÃo comió": "El niño comió", "für GrÃ¶Ã?e über": "für Größe über",
    }
    start = len(texts)
    texts += list(lost)
    df = docs(spark, texts)
    back = {r.doc_id: r.restored for r in mojibake.restored_texts(df).collect()}
    assert min(back) >= start
    good = [back.get(start + i) == want or want is None for i, want in enumerate(lost.values())]
    assert sum(good) >= len(lost) - 1 and back.keys() >= set(range(start, len(texts))), [back.get(start + i) for i in range(len(lost))]


def test_a_lattice_is_searched_in_full():
    import numpy as np

    rng = np.random.default_rng(0)
    counts = np.zeros(mojibake.BUCKETS, np.float32)
    counts[:] = rng.integers(0, 9, mojibake.BUCKETS)
    channel = mojibake.Channel(counts.tobytes())
    for window in ("aÃ©bÃ", "Ã¤Ã¼", "xÃ?yâ€", "Ð¿Ñ"):
        arcs = channel.arcs(window, "cp1252")
        paths = [(0, "")]
        every = []
        while paths:
            i, text = paths.pop()
            if i == len(window):
                every.append(text)
            else:
                paths += [(i + n, text + r) for n, readings in arcs[i] for r in readings]
        assert len(every) > 1
        score, text = channel.search(window, arcs, True, True)
        best = max(every, key=lambda x: channel.score(x, True, True))
        assert abs(score - channel.score(best, True, True)) < 1e-6 and abs(channel.score(text, True, True) - score) < 1e-6


def test_nothing_is_damaged_in_nothing(spark):
    assert mojibake.damaged_texts(docs(spark, [])).collect() == []
    assert mojibake.damaged_texts(docs(spark, [None, "", "abc"])).collect() == []
