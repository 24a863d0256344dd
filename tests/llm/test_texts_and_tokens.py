"""Language, secrets, tokens, records, fingerprints and licences against plain counterparts."""

from __future__ import annotations

import hashlib
import random
import re
import textwrap
import tracemalloc
import zlib
from binascii import crc32

import numpy as np
import pyarrow as pa
import pytest

from ridelake.llm import language, licences, merkle, pieces, queries, records, secrets

ODD = [None, "", " ", "   x", "a\tb\n\nc  d ", "é ﬁ ① 日本語 🙂  x", "▁▁ a▁b", "word " * 3000, "don't  stop now", "\u0000x", "#$%   12345678901"]


def corpus(spark, texts, **more):
    rows = [(i, t, "extra") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)


def test_pieces_match_the_library(spark):
    from sentencepiece import SentencePieceProcessor

    r = random.Random(2)
    alphabet = "abc déf ghi  jk▁\n\t.,0123日本 "
    texts = [*ODD, *("".join(r.choice(alphabet) for _ in range(r.randrange(200))) for _ in range(200)), ODD[4], ODD[4]]
    path = queries.tokenizer("piece_bpe_32k.model")
    model = SentencePieceProcessor(model_file=path)
    got = {x.doc_id: (list(x.ids), x.decoded) for x in pieces.encode(corpus(spark, texts).drop("ids"), path, ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        ids = model.encode(t or "")
        assert got[i] == (ids, model.decode(ids) if ids else ""), repr(t)
    assert pieces.encode(corpus(spark, texts).limit(0), path, ["doc_id"]).count() == 0


def test_a_full_chunk_table_changes_nothing():
    path = queries.tokenizer("piece_bpe_32k.model")
    small, large = pieces.Codec(path, table_rows=3), pieces.Codec(path)
    texts = ["one two three four", "four five", "", "six"]
    assert small.encode_decode(texts) == large.encode_decode(texts)


def test_records_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    path = queries.tokenizer("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    r = random.Random(4)
    alphabet = "ab cd  'st 're\n\t12日 "
    texts = [*ODD, *("".join(r.choice(alphabet) for _ in range(r.randrange(120))) for _ in range(150))]
    df = corpus(spark, texts)
    where = f"file://{tmp_path}/records"
    records.write(df, path, where)
    got = sorted((tuple(x) for x in records.read(spark, where).collect()))
    start = 0
    for (doc, at, n, crc), text in zip(got, texts, strict=True):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        assert (at, n, crc) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), (doc, repr(text))
        start += n
    dealt = [x.doc_id for x in records.shuffled(spark, where, 1).collect()]
    assert sorted(dealt) == list(range(len(texts))) and dealt != sorted(dealt)
    index = spark.read.parquet(f"{where}/index")
    assert index.count() == len(texts)


def test_records_find_damage():
    data = bytearray(records.frame(5, np.array([1, 2, 3], np.uint32), False))
    assert records.unframe(bytes(data), 0)[0] == 5
    for at in (2, len(data) - 6):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            records.unframe(bytes(broken), 0)


def test_records_of_nothing(spark, tmp_path):
    where = f"file://{tmp_path}/none"
    records.write(corpus(spark, ODD).limit(0), queries.tokenizer("byte_bpe_50k.json"), where)
    assert records.read(spark, where).count() == 0


def half_edit(text: str, other: str) -> str:
    n = len(text) // 2
    return text[: len(text) - n] + other[:n]


def test_fingerprints(spark):
    r = random.Random(6)
    texts = [*ODD, *("\n".join("".join(r.choice("abcd .") for _ in range(r.randrange(90))) for _ in range(r.randrange(12))) for _ in range(40))]
    texts += [texts[-1], texts[-2]]
    got = {x.doc_id: x for x in merkle.compare_with_edits(corpus(spark, texts)).collect()}
    n = len(texts)
    assert len(got) == n
    for i, t in enumerate(texts):
        after = texts[i - 1] if i else texts[n - 1]  # descending, the first follows the last
        changed = half_edit(t or "", after or "")
        assert got[i].edited == changed and got[i].n_chars == len(t or "")
        assert got[i].fingerprint == str(merkle.Tree.of(t or "")) and got[i].edited_fingerprint == str(merkle.Tree.of(changed))
        assert 0 <= got[i].near_edited <= 1 and (got[i].near_next == 1.0) == ((t or "") == (after or ""))
        assert (got[i].near_edited == 1.0) == (changed == (t or ""))
    assert got[n - 2].fingerprint == got[n - 3].fingerprint
    empty = merkle.compare_with_edits(corpus(spark, texts).limit(0))
    assert empty.count() == 0
    one = merkle.compare_with_edits(corpus(spark, ["only. one. text"])).collect()
    assert one[0].near_next == 1.0


def test_trees_locate_edits():
    text = "\n".join(f"Paragraph {i}. It has two sentences, number {i}." for i in range(60))
    parts = text.split("\n")
    parts[17] = "Something else."
    a, b = merkle.Tree.of(text), merkle.Tree.of("\n".join(parts))
    assert merkle.edits(a, b) == [17] and merkle.edits(a, a) == []
    assert merkle.Tree.parse(str(b)) == b and 0.9 < merkle.likeness(a, b) < 1
    assert merkle.likeness(a, merkle.Tree.of("nothing in common")) == 0


def base_by_hand(text: str) -> list[tuple]:
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(a, b, secrets.KINDS[k]) for a, k, b in sorted(found)]


def test_base_secrets():
    r = random.Random(8)
    bits = ["token=", "API_KEY: '", "apikey = \"", "pass word=", "Secret:", "passwd", "abc", "0123456789abcdef", "AKIA", "ABCDEFGH1234", " ", "\n", "é", "ſecret=abcdefg", "==", "="]
    for _ in range(500):
        text = "".join(r.choice(bits) for _ in range(r.randrange(1, 25)))
        assert secrets.base_spans(text) == base_by_hand(text), repr(text)


def test_secret_scan(spark):
    r = random.Random(9)
    hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    texts = [f"some words here token = {hexa(40)} and more words after that {i}" for i in range(120)]
    texts += [f"plain text number {i} with 2024-01-0{i % 9 + 1}-release/notes{i}" for i in range(120)]
    df = corpus(spark, [*texts, None, "", "x" * 300_000, "y é " + hexa(32)])
    network = secrets.fit(df, rows=200, made=200)
    got = {x.doc_id: x.findings for x in secrets.scan(df, network, ["doc_id"]).collect()}
    assert len(got) == len(texts) + 4
    for i, t in enumerate([*texts, "", "", "x" * 300_000]):
        base = [(f["start"], f["end"], f["kind"]) for f in got[i] if f["kind"] != "learned"]
        assert base == base_by_hand(t)
    assert [(f["start"], f["end"]) for f in got[len(texts) + 3]] == [(4, 36)]
    made = secrets.generated(texts[:50], 60, seed=99)
    p = network.probabilities(secrets.encoded([w for w, _ in made]))
    y = np.array([v for _, v in made])
    assert (p[y == 1] >= network.threshold).mean() > 0.8 and (p[y == 0] < network.threshold).mean() > 0.9
    again = secrets.fit(df, rows=200, made=200)
    assert np.array_equal(again.filters, network.filters)
    assert secrets.scan(df.limit(0), network, ["doc_id"]).count() == 0


def test_runs_beside_base_spans():
    """A run is cut at every base span in it: what is left before, between and behind is read, without the separators behind a span."""
    hexa, key = "0123456789abcdef01234567", "ghp_Ab3dEf9hIj2kLm5nOp8q"
    for text, want in [
        (f"https://h.io/{hexa}/{key} x", [key]),
        (f"{key}/{hexa}", [key + "/"]),
        (f"{hexa}-{key}={hexa}", [key + "="]),
        (f"{hexa}{hexa}", []),
        (f"{key} {hexa} {key}", [key, key]),
        (f"/{key}", ["/" + key]),
        (f"{hexa}/short", []),
        (f"a secret={key}", []),
        ("", []),
    ]:
        spans = secrets.base_spans(text)
        assert [text[a:b] for a, b in secrets.runs(text, spans)] == want, text
    r = random.Random(4)
    for _ in range(500):
        text = "".join(r.choice([hexa, key, "/", ".", " ", "token=", "é", "abcdef", "Q7"]) for _ in range(r.randrange(12)))
        spans = secrets.base_spans(text)
        inside = {i for a, b, _ in spans for i in range(a, b)}
        cut = "".join("\0" if i in inside else c for i, c in enumerate(text))
        cut = re.sub(r"(?<=\0)[-_/=+.]+", lambda m: "\0" * len(m[0]), cut)
        want = [m.span() for m in re.finditer(r"[A-Za-z0-9+/_=-](?:\.?[A-Za-z0-9+/_=-]){7,}", cut)]
        assert secrets.runs(text, spans) == want, repr(text)


def test_learned_spans_against_a_plain_loop(spark):
    """Windows, threshold, overlap and offsets of the learned spans, candidate by candidate and stretch by stretch."""
    r = random.Random(12)
    chars = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    pick = lambda n: "".join(r.choice(chars) for _ in range(n))
    hexa = "0123456789abcdef01234567"
    texts = [f"é 🙂 some words {pick(r.randrange(12, 300))} then {hexa}/{pick(30)} and token={pick(9)} or plain-words-{i}" for i in range(80)]
    df = corpus(spark, [*texts, None, ""])
    network = secrets.fit(df, rows=200, made=200)
    got = {x.doc_id: [(f["start"], f["end"], f["kind"]) for f in x.findings] for x in secrets.scan(df, network, ["doc_id"]).collect()}
    beside = 0
    for i, text in enumerate(texts):
        base = base_by_hand(text)
        learned: list[list[int]] = []
        for a, b in secrets.candidates(text, base):
            starts = [a] if b - a <= 40 else [*range(a, b - 40, 20), b - 40]
            for at in starts:
                end = min(at + 40, b)
                shown = ["\0"] * 72
                for place, where in [(k, at - 20 + k) for k in range(20)] + [(60 + k, end + k) for k in range(12)]:
                    shown[place] = text[where] if 0 <= where < len(text) else "\0"
                body = text[at:end]
                shown[20 : 20 + len(body[:28])], rest = body[:28], body[28:]
                shown[48 : 48 + len(rest)] = rest
                if network.probabilities(secrets.encoded(["".join(shown)]))[0] >= network.threshold:
                    if learned and at < learned[-1][1] and learned[-1][0] >= a:
                        learned[-1][1] = end
                    else:
                        learned.append([at, end])
        beside += any(text[a - 1] == "/" for a, _ in learned)
        assert got[i] == sorted([*base, *((a, b, "learned") for a, b in learned)], key=lambda x: (x[0], secrets.KINDS.index(x[2]))), text
    assert beside > 60 and got[80] == got[81] == []


def test_language(spark):
    words = {"aa": "the and of house river stone", "bb": "der und das haus fluss stein", "cc": "le et la maison fleuve pierre"}
    r = random.Random(10)
    texts, langs = [], []
    for lang, text in words.items():
        for _ in range(60):
            texts.append(" ".join(r.choice(text.split()) for _ in range(r.randrange(3, 40))))
            langs.append(lang)
    rows = [(i, t, lang, "s") for i, (t, lang) in enumerate(zip(texts, langs, strict=True))]
    rows += [(1000, None, "aa", "s"), (1001, "", "aa", "s"), (1002, "123 !?", "bb", "s"), (1003, "the " * 200_000, None, "s"), (None, "und das", "bb", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(5)
    held = {x.doc_id for x in df.where(language.held_out()).collect()}
    assert held == {i for i, *_ in rows if i is not None and crc32(str(i).encode()) % 4 == 2}
    model = language.fit(df.where(~language.held_out()))
    got = {x.doc_id: (x.lang_pred, x.score) for x in language.predict(df, model, ["doc_id"]).collect()}
    test = [i for i in held if i < 1000]
    assert sum(got[i][0] == langs[i] for i in test) / len(test) > 0.95
    assert got[1000] == got[1001] == got[1002] == ("und", 0.0) and got[1003][0] == "aa"
    assert all(0 <= s <= 1 for _, s in got.values())
    other = spark.createDataFrame([(7, texts[0], "zz", "q")], df.schema)  # neither label nor identifier counts
    assert language.predict(other, model, ["doc_id"]).first().lang_pred == got[0][0]
    none = language.fit(df.limit(0))
    assert {x.lang_pred for x in language.predict(df, none, ["doc_id"]).collect()} == {"und"}


def test_licences(spark):
    s = licences.SENTENCES
    mit = "\n\n".join(s[k] for k in ("MIT.grant", "MIT.notice", "MIT.warranty"))
    wrapped = re.sub(r"((?:\S+ ){8})", r"\1\n", mit)
    cases = [
        (mit, ["MIT"]),
        (wrapped.upper(), ["MIT"]),
        ("Text before. " + s["Apache.licensed"] + " Text behind.", ["Apache-2.0"]),
        ("\n".join(s[k] for k in ("BSD.head", "BSD.source", "BSD.binary")), ["BSD-2-Clause"]),
        ("\n".join(s[k] for k in ("BSD.head", "BSD.source", "BSD.binary", "BSD.endorse")), ["BSD-3-Clause"]),
        (s["CC-BY.licensed"] + "\n" + s["MIT.released"] + "\n" + s["MIT.released"], ["MIT", "CC-BY-4.0"]),
        ("We permit nothing. The licence is unknown.", []),
        ("plain", []),
        (None, []),
        ("", []),
        ("word " * 50_000 + s["GPL3.licensed"], []),
        ("word " * 50_000 + ". " + s["GPL3.licensed"], ["GPL-3.0-only"]),
    ]
    df = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(cases)], "doc_id long, text string, licences string")
    got = {x.doc_id: list(x.licences) for x in licences.scan(df).collect()}
    assert got == {i: found for i, (_, found) in enumerate(cases)}
    assert licences.scan(df.limit(0)).count() == 0


def test_threshold_comes_from_recall_alone():
    """Labels the scores can't tell apart: the recall asked for holds though all scores are low."""
    r = np.random.default_rng(3)
    made = secrets.generated(["some text around"], 300, seed=5)
    x, y = secrets.encoded([w for w, _ in made]), r.integers(0, 2, len(made)).astype(float)
    network = secrets.Network.new(1)
    network.calibrate(x, y, 0.97)
    hit = network.probabilities(x) >= network.threshold
    assert hit[y > 0].mean() >= 0.97 and network.precision == y[hit].mean()
    assert secrets.HARMLESS.fullmatch("2021-03-14-report") and not secrets.HARMLESS.fullmatch("xK9fLq2TzR7vWb4NcD8s")


def test_every_licence_in_its_wrapped_text(spark):
    heads = ("", "A License\n\nCopyright (c) 2020 X\n\n", "A License\nCopyright (c) 2020 X\n", "/*\n * Copyright 2020 X\n *\n * ")
    cases = [
        (licence, head + "\n\n".join(textwrap.fill(licences.SENTENCES[k], 72) for k in names) + "\n\nOther text")
        for licence, names in licences.RULES
        for head in heads[: 3 if len(licences.SENTENCES[names[0]]) < 72 else 4]
    ]
    cases.append(("GPL-2.0-or-later", "# " + textwrap.fill(licences.SENTENCES["GPL2.free"], 70).replace("\n", "\n# ")))
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    got = {x.doc_id: list(x.licences) for x in licences.scan(df).collect()}
    missing = [(licence, text[:40], got[i]) for i, (licence, text) in enumerate(cases) if licence not in got[i]]
    assert not missing


def test_digests(spark):
    text = "password = 'hunter22x'"
    (a, b, kind), = secrets.base_spans(text)
    assert hashlib.sha256(f"{kind}:{a}:{b}".encode()).hexdigest() == hashlib.sha256(b"assign:0:21").hexdigest()


def test_secrets_of_any_shape_and_place(spark):
    """Planted shapes, in long runs too; the network beside a plain loop over positions and filters."""
    r = random.Random(31)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    key = lambda n: "".join(r.choice(letters) for _ in range(n))
    for text in ("hunter2hunter2", "AbC123dEf456gHi", "qLwKeJrHtGyFuDiS", f"{key(30)}.{key(50)}.{key(43)}", key(8)[:7] + "9"):
        assert secrets.candidates(f"so {text} it", []) == [(3, 3 + len(text))], text
    assert secrets.candidates("plain words and/or numbers-2024 in_a_text, Mr.Smith went", []) == []
    assert secrets.candidates("abc12defg45 token=abcdefgh1", [(6, 20, "assign")]) == []
    assert secrets.stretches(0, 100) == [(0, 40), (20, 60), (40, 80), (60, 100)]
    texts = [f"this is a plain text of some words number {i} about nothing" for i in range(80)]
    planted = {i: key(32) for i in range(0, 80, 4)} | {1: "a/" * 60 + key(40) + "/b" * 60}
    made = [f"{t[:20]} {planted[i]} {t[20:]}" if i in planted else t for i, t in enumerate(texts)]
    df = corpus(spark, made)
    network = secrets.fit(df, rows=100, made=300)
    assert network.recall >= 0.97 and 0.5 < network.precision <= 1
    got = {x.doc_id: [f for f in x.findings if f["kind"] == "learned"] for x in secrets.scan(df, network, ["doc_id"]).collect()}
    assert sum(bool(got[i]) for i in planted) >= 0.95 * len(planted)
    assert not any(got[i] for i in range(80) if i not in planted)
    x = secrets.encoded([secrets.window("see " + key(20) + " end", 4, 24)])
    cells = [network.embed[int(c) + (secrets.N_CLASSES if secrets.BEFORE <= i < secrets.BEFORE + secrets.HEAD + secrets.TAIL else 0)] for i, c in enumerate(x[0])]
    pooled = []
    for f in range(network.filters.shape[1]):
        z = [
            max(0.0, sum(float(cells[i + j] @ network.filters[j * len(cells[0]) : (j + 1) * len(cells[0]), f]) for j in range(network.SPAN)) + network.bias[f])
            for i in range(len(cells) - network.SPAN + 1)
        ]
        pooled.append((max(z), sum(z) / len(z)))
    plain = sum(a * w for (a, _), w in zip(pooled, network.dense, strict=False)) + sum(
        m * w for (_, m), w in zip(pooled, network.dense[len(pooled) :], strict=False)
    ) + network.dense[-1]
    assert abs(plain - network.logits(x)[0]) < 1e-9


def test_a_full_table_keeps_what_is_met_again():
    """Words of every batch are encoded once, however many others fill the table; ids stay those of the library."""
    path = queries.tokenizer("byte_bpe_50k.json")
    encoder, asked = records.Encoder(path, table_rows=60), []
    learn = encoder.learn_words
    encoder.learn_words = lambda new: (asked.extend(new), learn(new))
    for i in range(40):
        texts = [f"common words of each batch {i}x{i * 7919}y{i * 104729}z", f"naïve\ncommon, and wörd{i}z once", "two  blanks <|x|>"]
        want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in encoder.encode(texts)] == want
        assert len(encoder.table) <= 60
    assert asked.count(" batch") == asked.count("common") == asked.count("naïve") == 1


def test_plain_words_are_those_of_the_pattern():
    """Cut on bytes, words are those of the pattern; texts that are not plain are told from those that are; ids are the library's."""
    letters, r = "A-Za-zÀ-ÖØ-öø-ɏ", random.Random(11)
    plain = re.compile(f"(?:[!-~{letters}]++|[ \n](?=[!-~{letters}]))*+")
    words = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[ ]?[{letters}]+|[ ]?[0-9]+|[ ]?[^ \n0-9{letters}]+|\n")
    mild, wild = "aZésɏstremdvl.,-12  \n" + 4 * "'", "aé×÷ɐ¿日\t\x00\x7f \n'"
    texts = ["", *("".join(r.choice(mild) for _ in range(r.randrange(25))) for _ in range(4000))]
    texts += ["".join(r.choice(mild + wild * (i % 2)) for _ in range(r.randrange(8))) for i in range(3000)]
    texts += ["ends in '", "s begins", "'r", "e", "it's", "'s's've'll''d'S", "x'", "", "re", "a<|endoftext|>b", "a<|endoftext|", "|>b"]
    encoder = records.Encoder(queries.tokenizer("byte_bpe_50k.json"), table_rows=3000)
    for part in (pa.array(texts), pa.array(texts).slice(7, 5000), pa.array(texts[:0], pa.string())):
        asked = part.to_pylist()
        found = encoder.plain(part)
        assert found.tolist() == [plain.fullmatch(t) is not None and "<|endoftext|>" not in t for t in asked]
        cut, counts = records.plain_words(part.filter(pa.array(found)))
        want = [words.findall(t) for t, p in zip(asked, found, strict=True) if p]
        assert cut.to_pylist() == [w for x in want for w in x] and counts.tolist() == [len(x) for x in want]
        ids = [e.ids for e in encoder.tokenizer.encode_batch(asked, add_special_tokens=False)]
        assert [x.tolist() for x in encoder.encode(part)] == ids == [x.tolist() for x in encoder.encode(asked)]


def test_words_of_a_text_are_no_python_objects():
    """A text of a million short words is encoded in less memory than a string and a place in a list for each word would take."""
    encoder = records.Encoder(queries.tokenizer("byte_bpe_50k.json"))
    text = "a b c d " * 250_000 + "e"
    encoder.encode([text[:20]])
    tracemalloc.start()
    (ids,) = encoder.encode([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(ids) == 1_000_001 and peak < 58 * len(ids)


def test_secrets_are_learned_from_every_document(spark):
    """Every labelled run of every text, long ones too, is an example; sums of tasks are those of one table; counts give the threshold."""
    texts = [f"word{i} token={'ab%05d' % i} then notes-2024-report/{i}" for i in range(3500)] + ["so long " * 5000 + "secret=abcdefgh1"]
    df = corpus(spark, texts)
    rows = secrets.examples(df, 1, 7).collect()
    want = sorted(w for t in texts for w in [(secrets.encoded([x])[0].tobytes(), y) for x, y in secrets.labelled(t, 1, 7)])
    assert sorted((bytes(r.x), r.y) for r in rows) == want
    assert len(want) >= 3 * 3500 + 1 and any(b - a == len("secret=abcdefgh1") for a, b, _ in secrets.base_spans(texts[-1]))
    part = [r for r in rows if not r.back][:700]
    x, y = np.array([list(r.x) for r in part], np.uint8), np.array([float(r.y) for r in part])
    network = secrets.Network.new(3)
    table = spark.createDataFrame([(r.x, r.y) for r in part], "x binary, y long").repartition(5)
    got = secrets._gradient(table, network, (0.4, 1.7))
    for g, h in zip(got, network.gradients(x, y, np.where(y > 0, 1.7, 0.4)), strict=True):
        assert np.abs(g - h).max() < 1e-6
    train = secrets.Network.train
    try:
        secrets.Network.train = lambda self, gradient: train(self, gradient, steps=2)
        fitted = secrets.fit(df)
    finally:
        secrets.Network.train = train
    back = [r for r in rows if r.back]
    x, y = np.array([list(r.x) for r in back], np.uint8), np.array([r.y for r in back])
    p = fitted.probabilities(x)
    allowed = int(0.03 * (y > 0).sum())
    assert abs(fitted.threshold - np.sort(p[y > 0])[allowed]) < 1e-8
    assert fitted.recall == (p[y > 0] >= fitted.threshold).mean() and abs(fitted.precision - y[p >= fitted.threshold].mean()) < 1e-12
