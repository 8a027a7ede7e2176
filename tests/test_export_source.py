"""The export data source against parsing the whole file, with ranges that cut records anywhere."""

import io

import pytest

from citegrain.sources import export_source, exports

RIS = "".join(f"TY  - JOUR\nTI  - Title {k} of é\nAU  - One, A.\nAU  - Two, B{k}.\nPY  - {1990 + k % 30}\nDO  - 10.1/{k}\nAB  - {'long text ' * (k % 40)}\nER  - \n\n" for k in range(120))
BIB = "\n".join(f"@article{{k{k},\n  title = {{The {{Title}} {k}}},\n  author = {{One, A and Two, B}},\n  year = {{{1990 + k}}},\n  doi = {{10.2/{k}}}\n}}\n" for k in range(60))
PLAIN = "FN Some\nVR 1.0\n" + "".join(f"PT J\nAU One, A\n   Two, B\nTI A title\n   of two lines {k}\nPY {2000 + k % 9}\nUT WOS:{k:09}\nER\n\n" for k in range(60)) + "EF\n"
TAB = "PT\tAU\tTI\tPY\tUT\n" + "".join(f"J\tOne, A; Two, B\tTitle \"{k}\tquoted\"\t{2000 + k % 9}\tWOS:{k}\n" for k in range(90))
CSV = "Authors,Title,Year,EID\n" + "".join(f'"One A., Two B.","Title\n{k} ""of""",{1990 + k},2-s2.0-{k}\n' for k in range(70))
FILES = {"a.ris": RIS.encode(), "b.bib": BIB.encode(), "c.txt": PLAIN.replace("\n", "\r\n").encode(), "d.tsv": TAB.encode(), "e.csv": CSV.encode(), "f.txt": RIS.encode("utf-8-sig"), "g.csv": CSV.encode("utf-16"), "h.ris": RIS.encode("latin-1"), "i.csv": CSV.replace("Two B.", "Tw\u00f6 B.").encode("latin-1")}


@pytest.mark.parametrize("size", [1, 50, 333, 10**6])
@pytest.mark.parametrize("name", ["a.ris", "b.bib", "c.txt", "d.tsv", "f.txt", "h.ris"])
def test_every_record_is_in_one_range(name, size, monkeypatch):
    raw = FILES[name]
    kind = exports.sniff(exports.decode(raw), "." + name.rsplit(".", 1)[-1])
    monkeypatch.setattr(export_source, "CHUNK", 90)
    stream = io.BytesIO(raw)

    def read(at, n):
        stream.seek(at)
        return stream.read(n)

    header = raw.split(b"\n", 1)[0] + b"\n" if kind == "wos_tab" else b""
    parts = [x for k in range(0, len(raw), size) for x in export_source.records_of(read, len(raw), kind, k, min(len(raw), k + size))]
    assert len({p for p, _ in parts}) == len(parts)
    rows = [r for p, x in parts if p >= len(header) for r in exports.READERS[kind](exports.decode(header + x))]
    assert rows == exports.parse(exports.decode(raw), "." + name.rsplit(".", 1)[-1])


def test_files_as_a_source(spark, tmp_path):
    """All files of a folder in many tasks give the records that reading whole files gives."""
    for name, raw in FILES.items():
        (tmp_path / name).write_bytes(raw)
    (tmp_path / "_SUCCESS").write_bytes(b"")
    got = export_source.read(spark, str(tmp_path), 700)
    assert got.rdd.getNumPartitions() > 20
    want = exports.read_exports(spark, *[str(tmp_path / n) for n in FILES])
    order = lambda df: [tuple(r)[:-1] for r in sorted(df.collect(), key=lambda r: (r.file, r.pos))]
    assert order(got.select(want.columns)) == order(want)
    (tmp_path / "x.exe").write_bytes(b"no")
    with pytest.raises(Exception, match="only"):
        export_source.read(spark, str(tmp_path)).collect()
