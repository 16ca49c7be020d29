from __future__ import annotations

import io
import zipfile

import pytest

from rillmark.operators import chunking
from rillmark.sources import files, parsers


def blocks(name: str, data: bytes) -> list[parsers.Block]:
    return parsers._PARSERS[name.rsplit(".", 1)[1]][0](data, name)


def test_markdown_trails_fences_and_setext():
    source = "intro\n# A\ntext a\n## B\n```\n# not a heading\n```\n# C\nTitle\n=====\nend\n"
    assert [(b.trail, b.text) for b in blocks("x.md", source.encode())] == [
        ((), "intro"), (("A",), "text a"), (("A", "B"), "```\n# not a heading\n```"), (("C",), "C"), (("Title",), "end"),
    ]


def test_rtf():
    data = rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}\f0 Caf\'e9 \b bold\b0\par \{x\} \u8364 ?}"
    assert blocks("x.rtf", data)[0].text.startswith("Café bold\n{x} €")


def test_csv_and_prose():
    card, table = blocks("d/x.csv", b"a;b\n1;2\n3;4\n")
    assert card.text == "x.csv: 2 rows; columns: a, b" and table.text == "a | b\n1 | 2\n3 | 4" and table.locator == "2-3"
    assert blocks("x.csv", b"Dear all,\nthis is prose.\nBye\n")[0].kind == "text"
    assert len(blocks("x.csv", ("a,b\n" + "1,2\n" * 100).encode())) == 1 + 4


def test_mail_thread():
    raw = "From: a@x\nTo: b@y\nSubject: Plan\n\nnew\nFrom: me\n\nOn Monday, A B wrote:\nold\nFrom: c\nSent: today\noldest\n"
    got = blocks("x.eml", raw.encode())
    assert got[0].kind == "envelope" and got[0].trail == ("Plan",)
    assert [b.text.split("\n")[-1] for b in got[1:]] == ["From: me", "old", "oldest"]


def test_transcripts():
    vtt = "WEBVTT\n\n00:01.000 --> 00:02.000\n<v Ana>hello\n\n00:02.000 --> 00:03.000\n<v Ana>hello there\n\nNOTE x\n00:02.500 --> 00:02.600\n\n00:20.000 --> 00:21.000\nBob: later\n"
    assert [(b.locator, b.text) for b in blocks("x.vtt", vtt.encode())] == [("00:01", "Ana: hello there"), ("00:20", "Bob: later")]
    assert parsers.cues("1\n01:00:00,500 --> 01:00:01,000\nhi")[0][0] == 3600.5


def package(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in parts.items():
            z.writestr(name, content)
    return out.getvalue()


def test_office_packages():
    docx = package({"word/document.xml": '<d xmlns:w="w"><w:body><w:p><w:pStyle w:val="Heading1"/><w:t>H</w:t></w:p><w:p><w:t>te</w:t><w:t>xt</w:t></w:p><w:tbl><w:tr><w:tc><w:t>1</w:t></w:tc><w:tc><w:t>2</w:t></w:tc></w:tr></w:tbl></w:body></d>'})
    assert [(b.trail, b.kind, b.text) for b in blocks("x.docx", docx)] == [(("H",), "text", "text"), (("H",), "table", "1 | 2")]
    pptx = package({f"ppt/slides/slide{i}.xml": f"<s><p><t>T{i}</t></p><p><t>b</t></p></s>" for i in (10, 2)} | {"ppt/notesSlides/notesSlide2.xml": "<s><p><t>note</t></p></s>"})
    assert [(b.locator, b.kind, b.trail) for b in blocks("x.pptx", pptx)] == [("slide 2", "slide", ("T2",)), ("slide 2", "notes", ("T2",)), ("slide 10", "slide", ("T10",))]
    xlsx = package({
        "xl/workbook.xml": '<w><sheet name="S"/></w>', "xl/sharedStrings.xml": "<s><si><t>h</t></si></s>",
        "xl/worksheets/sheet1.xml": '<w><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5.0</v></c></row><row><c r="B2" t="inlineStr"><is><t>x</t></is></c></row></w>',
    })
    assert [b.text for b in blocks("x.xlsx", xlsx)][1] == "h |  | 5\n | x"


def test_every_failure_becomes_a_row(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name, data in {"a/ok.txt": b"hi", "bad.docx": b"no zip", "empty.txt": b" ", "x.bin": b"1", "big.md": b"y" * 2_000_000}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r.status for r in files.read_documents(spark, str(tmp_path), limits_mb={"md": 1}).collect()}
    assert got == {"ok.txt": "ok", "bad.docx": "error", "empty.txt": "empty", "x.bin": "no parser", "big.md": "deferred"}
    census = {r.path: (r.size, r.depth) for r in files.census(spark, str(tmp_path)).collect()}
    assert census["a/ok.txt"] == (2, 1) and census["x.bin"] == (1, 0)


def test_exclusion_rules(spark):
    rows = spark.createDataFrame([(p,) for p in ("a/Cache/x.txt", "a/~tmp.doc", "mail/in.log", "b/in.log", "ok.txt")], "path string")
    got = files.exclude(rows, folders=("cache",), names=("~*",), roles=(("*.log", ("mail",)),))
    assert {r.path: r.rule for r in got.collect()} == {"a/Cache/x.txt": "folder cache", "a/~tmp.doc": "name ~*", "mail/in.log": "role *.log", "b/in.log": None, "ok.txt": None}
    assert [r.rule for r in files.unused_rules(got, ["folder cache", "name *.bak"]).collect()] == ["name *.bak"]


def test_chunks_are_bounded_and_lose_nothing():
    text = " ".join(f"word{i}" for i in range(2000))
    parts = chunking.cut(text)
    assert all(len(p) <= 1800 for p in parts) and set(" ".join(parts).split()) >= set(text.split())
    assert chunking.cut("x" * 4000) and max(map(len, chunking.cut("x" * 4000))) == 1800
    table = "h1 | h2\n" + "\n".join(f"{i} | {'v' * 50}" for i in range(100))
    assert all(p.startswith("h1 | h2\n") and len(p) <= 1800 for p in chunking.cut_table(table))
    joined = chunking.chunk([(("a",), "1", "text", "x"), (("a",), "2", "text", "y"), (("b",), "3", "text", "z")])
    assert joined == [(("a",), "1–2", "text", "x\ny"), (("b",), "3", "text", "z")]


def test_chunk_table(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\n" + "sentence one. " * 400)
    got = chunking.chunks(files.read_documents(spark, str(tmp_path))).orderBy("ordinal").collect()
    assert [r.ordinal for r in got] == list(range(len(got))) and len({r.chunk_id for r in got}) == len(got) > 1
    assert got[0].trail == ["T"] and got[0].locator == f"(1/{len(got)})"
