"""Connectors: byte ranges that cut lines anywhere, streams by byte offset, feeds by kind."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from worldlog.sources import connectors, feeds, provenance


def lines_of(raw: bytes) -> list[tuple[int, bytes, bool]]:
    out, at = [], 0
    for piece in raw.split(b"\n")[:-1]:
        out.append((at, piece, True))
        at += len(piece) + 1
    return out + ([(at, raw[at:], False)] if at < len(raw) else [])


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 100_000])
def test_ranges_own_each_line_once(tmp_path, size, monkeypatch):
    draw = random.Random(size)
    for n, chunk in enumerate((1, 5, 1 << 20)):
        monkeypatch.setattr(connectors, "CHUNK_BYTES", chunk)
        raw = b"".join(bytes(draw.choices(b"ab\xc3\xa9\r", k=draw.choice([0, 1, 9, 30]))) + b"\n" for _ in range(25)) + draw.choice([b"", b"torn"])
        path = tmp_path / f"s{n}"
        path.write_bytes(raw)
        found = [x for r in connectors._ranges(str(path), 0, len(raw), size, True) for x in connectors._lines(r)]
        assert found == lines_of(raw)


def test_segments(spark, tmp_path):
    good = [json.dumps({"seq": i, "pad": "é" * (i % 90)}, ensure_ascii=False) for i in range(2_000)]
    texts = ["\n".join(good[:700]) + "\n", "\n".join(["", "{}\r", "{bad", *good[700:]]) + "\n", '{"seq": 1}\n{"seq":']
    for i, t in enumerate(texts):
        (tmp_path / f"seg-{i}").write_bytes(t.encode())
    (tmp_path / "seg-3").write_bytes(b"\xff\xfe\n")
    (tmp_path / "seg-4").write_bytes(b"")
    (tmp_path / "_SUCCESS").write_bytes(b"x")
    got = connectors.segments(spark, str(tmp_path), range_bytes=997)
    assert got.rdd.getNumPartitions() > 20
    rows = got.collect()
    assert sorted(r.line for r in rows if r.problem is None) == sorted([*good, '{"seq": 1}'])
    assert sorted((r.file, r.offset, r.problem) for r in rows if r.problem) == [
        ("seg-1", 0, "EMPTY_LINE"), ("seg-1", 1, "CARRIAGE_RETURN"), ("seg-1", 5, "INVALID_JSON"), ("seg-2", 11, "TORN"), ("seg-3", 0, "NOT_UTF8"),
    ]
    assert connectors.segments(spark, f"file://{tmp_path}", 5_000).count() == len(rows)
    (tmp_path / "none").mkdir()
    assert connectors.segments(spark, str(tmp_path / "none")).count() == 0


def test_a_stream_reads_on_from_its_bytes(spark, tmp_path):
    log, out, state = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "state")
    log.mkdir()

    def read_on():
        stream = connectors.segment_stream(spark, str(log), range_bytes=64)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(out).select("file", "offset", "line", "problem").collect())

    (log / "a").write_text('{"n":1}\n{"n":2}\n{"n"')
    assert read_on() == [("a", 0, '{"n":1}', None), ("a", 8, '{"n":2}', None)]
    with (log / "a").open("a") as f:
        f.write(':3}\nbad\n')
    (log / "b").write_text('{"m":1}\n')
    want = [("a", 0, '{"n":1}', None), ("a", 8, '{"n":2}', None), ("a", 16, '{"n":3}', None), ("a", 24, "bad", "INVALID_JSON"), ("b", 0, '{"m":1}', None)]
    assert read_on() == want
    assert read_on() == want
    (log / "a").write_text('{"n":1}\n')
    with pytest.raises(Exception, match="shorter|shrank"):
        read_on()


def test_connectors_by_kind(spark):
    rows = [
        (1, "s", "id,amount,ok\n7,1.5,yes\n8,,no\n"), (2, "s", "id,amount,ok\n7,1.5\n"), (3, "s", "id,amount,ok\n"), (4, "s", 'id,amount,ok\n"a\nb",x,1\n'), (5, "s", None), (6, "s", "id,amount,ok\n7,1.5,yes\n8,,no\n"),
    ]
    table = spark.createDataFrame(rows, "payload_id long, source_id string, body string").withColumn("problem", F.lit(1))
    feed = connectors.connector("csv", "c", "orders", types={"id": "integer", "amount": "number", "ok": "boolean"})
    got = {r.payload_id: r for r in connectors.ingestions(feed.payloads(table)).collect()}
    assert json.loads(got[1].body) == {"rows": [{"id": 7, "amount": 1.5, "ok": True}, {"id": 8, "amount": None, "ok": False}]}
    assert json.loads(got[4].body) == {"rows": [{"id": "a\nb", "amount": "x", "ok": True}]}
    assert {i for i, r in got.items() if r.problem == "MALFORMED_PAYLOAD"} == {2, 3, 5}
    assert {i: r.duplicate_of for i, r in got.items() if r.duplicate_of} == {6: 1}

    rows = [(1, "s", '{"e":"x","v":1}'), (2, "s", '{"e":"x","v":2}'), (3, "t", '{"e":"x"}'), (4, "s", "[1]"), (5, "s", '{"v":1}'), (6, "s", '{"v":1}'), (7, "s", '{"a":1,"a":2}')]
    table = spark.createDataFrame(rows, "payload_id long, source_id string, body string")
    got = {r.payload_id: r for r in connectors.ingestions(connectors.connector("json", "j", "notes", "e").payloads(table)).collect()}
    assert {i: r.duplicate_of for i, r in got.items() if r.duplicate_of} == {2: 1, 6: 5}
    assert {i for i, r in got.items() if r.problem} == {4, 7}
    geo = connectors.connector("geojson", "g", "places").payloads(table.union(spark.createDataFrame([(8, "s", '{"type":"FeatureCollection","features":[]}')], table.schema)))
    assert [r.payload_id for r in geo.filter("problem IS NULL").collect()] == [8]
    with pytest.raises(ValueError, match="unknown connector kind"):
        connectors.connector("pdf", "x", "y")


def test_provenance_words_lose_no_match(spark):
    """Trying a type's pattern only where one of its words stands gives what trying all patterns gives."""
    draw = random.Random(12)
    says = [
        "Published by", "PUBLISHER:", "PUBLİSHED BY", "publıshed by", "publiſhed  by", "Herausgegeben von", "HERAUSGEBER", "Éditeur :", "editeur", "publié par", "PUBLIÉ PAR", "Publicado por", "Editado por", "pubblicato da", "issued by", "ISSUING AUTHORITY",
        "erlassen von", "émis par", "EMIS PAR", "emitido por", "emesso da", "\nby Ann Bo\n", "edited by", "Editor", "Redaktion", "RÉDACTEUR", "submitted by", "uploaded by", "deposited by", "eingereicht von", "soumis par", "presentado por", "© 2001", "(C)", "Copyright",
        "translated by", "translation of", "Übersetzt von", "ubersetzung von", "traduit par", "traduction de", "traducido por", "tradotto da", "syndicated from", "via AFP", "VIA PA  Media", "wire service", "mirrored from", "mirror site", "Spiegelserver", "miroir de", "espejo de",
        "the Wayback Machine", "archived by", "Archive-It", "internet archive", "archiviert von", "the wayback machine", "the WAYBAC\u212a machine", "reda\u212ation", "archivé par", "commissioned by", "prepared for", "study for", "im Auftrag von", "commandé par", "encargado por", "operated by", "managed by", "betrieben von", "exploité par", "gestionado por",
        "owned by", "a subsidiary of", "a division of", "Eigentümer", "eigentumer", "propriété de", "propiedad de", "Official Journal of", "Amtsblatt der", "Journal officiel du", "Diario Oficial de", "gazzetta ufficiale della", "This act revises", "replaces", "supersedes", "amends", "corrects",
        "withdraws", "retracts", "consolidates", "COM 2020-33", "AD No. 12/45", "L 1.2.3", "C ١٢٣", "published on 3 May 2021", "of 12 June 1999", "For more information, contact", "Press Office", "Pressestelle", "contact presse",
    ]
    rows = [(i, "".join(draw.choices([*says, "x", " of ", "\n", " | ", " The Office of Papers", " Line & Co.", " ", "K", "."], k=draw.randint(1, 60)))) for i in range(400)] + [(900 + i, s + " The Body of it") for i, s in enumerate(says)] + [(998, None), (999, "")]
    table = spark.createDataFrame(rows, "id long, body string")
    got, want = (sorted(map(tuple, provenance.captured(table, "id", "body", everywhere).collect())) for everywhere in (False, True))
    assert got == want
    assert {x[1] for x in got} == set(provenance.PATTERNS)


def test_leaves_and_items_that_are_not_read(spark):
    deep = "[" * 20_000 + "1" + "]" * 20_000
    rows = [(1, deep), (2, '{"a":1,"a":2}'), (3, "{"), (4, '{"a":"[[[","b":[{"c":null}]}'), (5, None), (6, "[" * 256 + "]" * 256), (7, "[" * 257 + "]" * 257)]
    got = feeds.json_leaves(spark.createDataFrame(rows, "id long, body string"), "id", "body").collect()
    assert sorted((r.id, r.path, r.value, r.problem) for r in got if r.problem) == [(1, None, None, "TOO_DEEP"), (2, None, None, "INVALID"), (3, None, None, "INVALID"), (7, None, None, "TOO_DEEP")]
    assert [(r.path, r.value) for r in got if r.id == 4] == [("$.a", "[[["), ("$.b[0].c", "")]
    feeds_ = [(1, "<!DOCTYPE x><rss><channel><item><guid>1</guid></item></channel></rss>"), (2, "<rss><channel></channel></rss>"), (3, None), (4, "<rss><channel><item><title>t</title></item><item><guid>g</guid></item></channel></rss>"), (5, '<feed><entry><id>e</id></entry><entry><title>u</title><link href="http://x"/></entry></feed>')]
    found = feeds.feed_items(spark.createDataFrame(feeds_, "id long, body string"), "id", "body").collect()
    assert sorted((r.id, r.native_id or "", r.problem) for r in found) == [(1, "", "DTD_REFUSED"), (2, "", "NO_ITEMS"), (3, "", "NO_ITEMS"), (4, "", "NO_NATIVE_ID"), (4, "g", None), (5, "e", None), (5, "http://x", None)]


def test_strict_json(spark):
    def plain(text):
        def depth(v, at=0):
            inside = [depth(x, at + 1) for x in (v.values() if isinstance(v, dict) else v)] if isinstance(v, (dict, list)) else []
            return max([at + 1 if isinstance(v, dict) and v else at, *inside])

        def once(pairs):
            if len({k for k, _ in pairs}) < len(pairs):
                raise ValueError
            return dict(pairs)

        try:
            value = json.loads(text, object_pairs_hook=once, parse_constant=lambda c: [][0])
        except (ValueError, IndexError):
            return "INVALID"
        if depth(value) > 256:
            return "TOO_DEEP"
        try:
            json.dumps(value, ensure_ascii=False).encode()
        except UnicodeEncodeError:
            return "LONE_SURROGATE"
        return None if isinstance(value, dict) else "NOT_AN_OBJECT"

    nest = lambda n, inside, a="[", b="]": '{"k":' + a * n + inside + b * n + "}"
    texts = ["{}", '{"a":1}', '{"a":1,"a":1}', "{", "[1]", "3", '"x"', '{"a":NaN}', "", '{"a":"\\ud83d\\ude00"}', '{"a":"\\ud83d"}', '{"a":"\\\\ud83d"}', '{"a":"\\ude00x"}', '{"\\udfff":1}', '{"a":"' + "[" * 400 + '"}', '{"a":"' + "x" * 20_000 + '\\"[' * 300 + '"}']
    texts += [nest(n, inside) for n in (254, 255, 256, 257) for inside in ("", "1", '"s"', "[]", "{}", " ", "null")] + [nest(n, "1", '{"q":', "}") for n in (254, 255, 256, 257)] + ['{"a":[' + ",".join(["[1]"] * 500) + "]}"]
    got = {r.t: r.p for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", feeds.strict_json(F.col("t")).alias("p")).collect()}
    assert {t: p for t, p in got.items() if p != plain(t)} == {}
