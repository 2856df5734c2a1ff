"""Workbooks and the trailing window over streams."""

import random
import zipfile
from xml.sax.saxutils import escape

import pytest

from tessera.sources import transcripts, workbooks
from tessera.streaming import transcripts as streams

HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def write_workbook(path, sheet, shared=()):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'{HEAD}<workbook {NS} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="A" sheetId="1" r:id="rId7"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId7" Type="t" Target="worksheets/first.xml"/></Relationships>')
        z.writestr("xl/worksheets/first.xml", f"{HEAD}<worksheet {NS}><sheetData>{sheet}</sheetData></worksheet>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f"{HEAD}<sst {NS}>" + "".join(f"<si>{s}</si>" for s in shared) + "</sst>")


def inline(reference, text):
    return f'<c r="{reference}" t="inlineStr"><is><t>{escape(text)}</t></is></c>'


def test_sheet_rows(tmp_path):
    write_workbook(
        tmp_path / "x.xlsx",
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="2"><c r="B2"><v>2.5</v></c><c r="C2" t="b"><v>1</v></c><c r="AA2" t="e"><v>#N/A</v></c></row><row r="3"/>',
        ("<t>word</t>", "<r><t>st</t></r><r><t>art</t></r>"),
    )
    rows = list(workbooks.sheet_rows((tmp_path / "x.xlsx").read_bytes()))
    assert rows[0] == ["word", None, "start"] and rows[1][:3] == [None, "2.5", "true"] and len(rows[1]) == 27 and rows[1][26] is None and rows[2] == []


def test_read_files(spark, tmp_path):
    for name, words in (("p1", ["hi", "you & me"]), ("p2.final", ["only"]), ("p3", [])):
        sheet = f'<row r="1">{inline("A1", "content")}{inline("B1", "start")}{inline("C1", "end")}</row>'
        sheet += "".join(f'<row r="{i + 2}">{inline(f"A{i + 2}", w)}<c r="B{i + 2}"><v>{i}</v></c>{inline(f"C{i + 2}", "x")}</row>' for i, w in enumerate(words))
        write_workbook(tmp_path / f"{name}.xlsx", sheet)
    raw = transcripts.read_files(spark, str(tmp_path), ".xlsx")
    assert raw.columns == [workbooks.FILE, "content", "start", "end"] and raw.count() == 3
    df = transcripts.read_catalogue(spark, [transcripts.Source("Azure", str(tmp_path), ".xlsx")])
    assert sorted((r.srcID, r.pID, r.word, r.s, r.e) for r in df.collect()) == [("Azure", "p1", "hi", 0.0, None), ("Azure", "p1", "you & me", 1.0, None), ("Azure", "p2", "only", 0.0, None)]
    with pytest.raises(ValueError):
        transcripts.read_files(spark, str(tmp_path), ".doc")


def test_trailing_windows(spark, tmp_path):
    """The stream's windows are the batch's, whatever the batches; late and repeated tokens
    change nothing."""
    rng = random.Random(0)
    rows = [(p, i, f"{p}{rng.randrange(9)}") for p, n in (("a", 40), ("b", 3), ("c", 1)) for i in range(n)]
    schema = "pID string, pos long, token string"
    cuts = [[r for r in rows if lo <= r[1] < hi] for lo, hi in ((0, 7), (7, 8), (8, 30), (30, 99))]
    cuts[2] += [r for r in cuts[0] if r[0] == "a"]
    for k, part in enumerate(cuts):
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/part={k}")
    stream = spark.readStream.schema(schema + ", part int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").select("pID", "pos", "token")
    q = streams.trailing_windows_stream(stream, 4).writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination(300)
    want = streams.trailing_windows(spark.createDataFrame(rows, schema), 4)
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, want.collect()))


def test_label_catalogue(spark, tmp_path):
    """Sources are labelled against the first one, in one run that can be repeated and goes on
    with what is new."""
    from tessera.operators import labelling

    def write(source, name, lines):
        (tmp_path / source).mkdir(exist_ok=True)
        (tmp_path / source / f"{name}.csv").write_text("\n".join(lines) + "\n")

    hand = ["speaker,text,t0,t1,uID", "PAR,the,0.0,,u1", "PAR,cat,,2.0,u1", "INV,yes,2.0,3.0,u2", "PAR,sat,3.0,4.0,u3"]
    for p in ("p1", "p2", "skipped"):
        write("hand", p, hand)
    for p in ("p1", "p2", "skipped", "unknown"):
        write("asr", p, ["word,start,end", "The,0.0,1.0", "hat,1.0,2.0", "yes,2.0,3.0", "uh,2.1,2.9", "sat,3.0,4.0"])
    write("late", "p1", ["content,start,end", "cat,0,1"])
    sources = [transcripts.Source(n, str(tmp_path / n), "csv") for n in ("hand", "asr", "late")]
    out = str(tmp_path / "out")
    first = labelling.label_catalogue(spark, sources[:2], out, skip=("skipped",))
    want = [(0, "The", "equal", "the"), (1, "hat", "sub", "cat"), (4, "sat", "equal", "sat")]
    got = sorted(tuple(r) for r in first.select("srcID", "pID", "pos", "word", "align_op", "truth_word").collect())
    assert got == [("asr", p, *w) for p in ("p1", "p2") for w in want]
    assert {r.speaker_id for r in spark.read.parquet(out).collect()} == {"PAR"}
    again = labelling.label_catalogue(spark, sources, out, skip=("skipped",))
    assert [(r.srcID, r.pID, r.word) for r in again.collect()] == [("late", "p1", "cat")]
    assert spark.read.parquet(out).count() == 7
    assert labelling.label_catalogue(spark, sources, out, skip=("skipped",)).count() == 0


def test_lexical_readers(spark, tmp_path):
    from tessera.operators import coherence

    (tmp_path / "v.csv").write_text(",0,1\ncat,0.5,1\ndog,1e-3,x\n")
    (tmp_path / "e.csv").write_text(",entropy\ncat,0.25\n")
    (tmp_path / "s.tsv").write_text("the\t1\n a \t2\n\nthe\t3\n")
    v = {r.token: r.vec for r in transcripts.read_vectors(spark, str(tmp_path / "v.csv")).collect()}
    assert v == {"cat": [0.5, 1.0], "dog": [0.001, None]}
    assert [tuple(r) for r in transcripts.read_entropy(spark, str(tmp_path / "e.csv")).collect()] == [("cat", 0.25)]
    stop = transcripts.read_stop_words(spark, str(tmp_path / "s.tsv"))
    assert sorted(r.token for r in stop.collect()) == ["a", "the"]
    tokens = spark.createDataFrame([(1, 0, "the"), (1, 1, "cat")], "pID int, pos int, token string")
    assert [r.token for r in coherence.without_stop_words(tokens, stop).collect()] == ["cat"]
    with pytest.raises(ValueError):
        coherence.checked(transcripts.read_vectors(spark, str(tmp_path / "v.csv")))
    fine = spark.createDataFrame([("a", 1, [1.0, 2.0]), ("b", 2, [1.0])], "token string, id long, vec array<double>")
    assert coherence.checked(fine.limit(1)).count() == 1
    with pytest.raises(ValueError):
        coherence.checked(fine)
