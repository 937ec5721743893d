"""Token counts, license scans, secret scans and media columns against plain Python."""

import hashlib
import random
import re
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from marginalia.llm import licenses, media, secrets
from marginalia.llm.tokens import PrefixCounter, count_prefix, cut, pack_table, token_counts, unpack_table
from tests.llm.conftest import awkward_rows

PATH = public_tokenizers.path("word_bpe_49k.json")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def rows(df, *keys):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: tuple((r[k] is None, r[k] if r[k] is not None else 0) for k in keys))


def texts():
    return sorted(((i, t or "") for i, t, *_ in awkward_rows()), key=lambda x: (x[0] is None, x[0] or 0))


def test_token_counts_are_the_librarys(awkward, none_at_all):
    lib = Tokenizer.from_file(PATH)
    got = rows(token_counts(awkward, PATH, limit=100), "doc_id")
    assert [r["doc_id"] for r in got] == [i for i, _ in texts()]
    for r, (_, t) in zip(got, texts(), strict=True):
        n = len(lib.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 100)
        table = unpack_table(bytes(r["prefix_table"]))
        assert table.sum() == n and len(table) == len(t)
        if len(t) < 300:
            each = [len(lib.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]
            assert r["cut_chars"] == max(i for i, k in enumerate(each) if k <= 100)
        assert len(lib.encode(t[: r["cut_chars"]], add_special_tokens=False).ids) <= 100
    assert token_counts(none_at_all, PATH).count() == 0


def fuzz(n, seed=3):
    """Texts of many scripts, marks, contractions, special strings cut short, and white space of all kinds."""
    rnd = random.Random(seed)
    codes = [*range(32, 127), *range(32, 127), *range(0xA0, 0x600), *range(0x900, 0xA00), *range(0x3040, 0x3100), *range(0x4E00, 0x4E80), *range(0xAC00, 0xAC40), *range(0x1100, 0x1200)]
    codes += [0x1F600, 0x1F64F, 0x300, 0x301, 0x323, 0x130, 0x3A3, 0x85, 0x1C, 0x200B, 0xFEFF, 0x2028, 0xA7CB, 0xA7DC, 0x32808]
    usual = ["the ", "ing", " ", "'re", "'s", "\n", "123", "éa", "<|endoftext|>", "<|end", "Σ", "ΑΣ ", "é", "«Ən yaxşı» "]
    return ["".join(chr(rnd.choice(codes)) if rnd.random() < 0.5 else rnd.choice(usual) for _ in range(rnd.randint(1, 40))) for _ in range(n)]


def test_every_prefix_is_the_librarys():
    c = PrefixCounter(PATH)
    for t in ("It's we'll go!! now''s 12a thread-safe", "Ünïcode straße  x ", "", "ab" * 700, *fuzz(400)):
        table = unpack_table(pack_table(c.table(t)))
        want = c.encode_counts([t[:i] for i in range(len(t) + 1)])
        assert [0, *table.cumsum().tolist()] == want
        assert count_prefix(table, len(t) // 2) == want[len(t) // 2]
        for budget in (0, 1, 3, 100):
            assert cut(table, budget) == max(i for i, k in enumerate(want) if k <= budget)


def test_every_character_beside_letters():
    c = PrefixCounter(PATH)
    texts = [f"a{chr(x)}b {chr(x)}" for x in range(0x3000) if not 0xD800 <= x < 0xE000]
    assert [int(c.table(t).sum()) for t in texts] == c.encode_counts(texts)


def test_segments_count_as_texts_of_their_own():
    c = PrefixCounter(PATH)
    for t in (*fuzz(150, 5), "word " * 300, "solid" * 300, "", "  "):
        for longest in (3, 17):
            got = c.segments(t, longest)
            assert "".join(t[a:b] for a, b, _ in got) == t and [k for *_, k in got] == c.encode_counts([t[a:b] for a, b, _ in got])
            assert all(k <= longest or b - a == 1 or k <= longest + 2 for a, b, k in got)


def test_license_scan(awkward, none_at_all):
    got = rows(licenses.scan(awkward), "doc_id")
    assert len(got) == len(texts())
    for r, (i, t) in zip(got, texts(), strict=True):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))
        at, labels = [], set()
        for p, label in licenses.BASE_PHRASES.items():
            m = [k for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
            at += m
            labels |= {label} if m else set()
        assert (r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (i, len(w), len(at), min(at, default=None), max(at, default=None))
        assert r["base_labels"] == ",".join(sorted(labels)) and labels <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert [r["labels"] for r in got if r["doc_id"] == 13] == ["cc-by,cc-by-nc,gpl"]
    assert licenses.scan(none_at_all).count() == 0


def test_license_diagonals_merge_over_an_inserted_word(spark):
    t = "permission is hereby granted free of charge to any nice person obtaining a copy of this software and associated documentation files"
    r = licenses.scan(spark.createDataFrame([(1, t), (2, "permission is hereby denied")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert r[0].labels == "mit" and len(r[0].spans) == 1 and r[0].spans[0].start == 0 and r[1].labels == ""


def test_whole_licenses_are_spans(spark):
    whole = {label: t for label, ts in licenses.TEMPLATES.items() for t in ts if len(t) > 300}
    docs = [(i, f"some code before\n{t}\nand after") for i, t in enumerate(whole.values())]
    docs += [(10 + i, re.sub("(the|THE)", r"\1 very", t, count=3)) for i, t in enumerate(whole.values())]  # words put in
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, label in enumerate(whole):
        for d in (i, 10 + i):
            assert label in got[d].labels.split(",") and any(s.label == label and s.end - s.start > 0.8 * len(licenses.words(whole[label])) for s in got[d].spans)
    assert len(whole) >= 4


def spans(t):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def test_secret_scan(awkward, none_at_all):
    got = rows(secrets.scan(awkward), "doc_id")
    assert len(got) == len(texts())
    for r, (i, t) in zip(got, texts(), strict=True):
        want = spans(t)
        listed = [f"{secrets.ORDER[k]}:{a}:{b}" for a, k, b in want]
        assert r["doc_id"] == i and (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == j for _, k, _ in want) for j in range(3))
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s and not s.startswith("live")] == listed
    assert secrets.scan(none_at_all).count() == 0


def test_ownership_parts_examples_from_live_values(spark):
    d = [(i, "password=examplevalue123", f"s{i}") for i in range(4)] + [(9, "password=livevalue987xyz", "s1"), (10, "password=livevalue987xyz", "s1")]
    df = spark.createDataFrame(d, "doc_id long, text string, source string").selectExpr("*", "'en' as lang")
    r = {x.doc_id: x for x in secrets.scan(df).collect()}
    assert all(r[i].n_example == 1 and r[i].n_live == 0 for i in range(4)) and r[9].n_live == r[10].n_live == 1
    m = {x.doc_id: x.text for x in secrets.masked(df).collect()}
    assert m[0] == "password=examplevalue123" and m[9] == "password=[secret]"


def test_media_round_trip(awkward, none_at_all):
    got = rows(media.media_columns(awkward), "doc_id")
    assert len(got) == len(texts())
    for r, (i, t) in zip(got, texts(), strict=True):
        p = media.pad(t.encode())
        assert len(p) % 192 == 0 and p.rstrip(b" ") == t.encode().rstrip(b" ")
        assert (r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (i, len(t.encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert r["media_sha256"] == hashlib.sha256(media.encode_png(p)).hexdigest() and media.decode_png(media.encode_png(p)) == p
    assert media.media_columns(none_at_all).count() == 0


def test_media_blocks_and_damage(spark, awkward):
    from marginalia.llm.common import file_system

    root = media.write_archives(awkward, block_bytes=2000)
    reader = media.MediaReader({"path": root})
    assert len(reader.partitions()) > 3
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == awkward.count()
    fs, base = file_system(root)
    p = reader.partitions()[0]
    with fs.open_input_file(f"{base}/{p.archive}") as f:
        data = bytearray(f.read())
    data[60] ^= 255
    with fs.open_output_stream(f"{base}/{p.archive}") as f:
        f.write(bytes(data))
    with pytest.raises(ValueError, match="member"):
        list(reader.read(p))
