import gzip

import pytest
from pyspark.sql import functions as F

from corvidex.operators.collection import Collection
from corvidex.plans import language as L
from corvidex.sources import plugins, records, xml

PROTEIN = """ID   TEST_HUMAN              Reviewed;          12 AA.
AC   P00001;
DT   21-JUL-1986, integrated.
DE   RecName: Full=Test protein 2;
DE   AltName: Full=Other.
OS   Homo sapiens (Human).
RN   [1]
CC   -!- FUNCTION: binds 3 things.
CC   -----------------------------------------------------------------------
CC   Copyrighted by the UniProt Consortium, see http://www.uniprot.org/terms
KW   Kinase.
SQ   SEQUENCE   12 AA;  1234 MW;  ABCDEF0123456789 CRC64;
     MKVLAAGIVA LS
//
ID   SECOND_MOUSE            Reviewed;           5 AA.
DE   RecName: Full=Second.
SQ   SEQUENCE   5 AA;  500 MW;  ABC CRC64;
     MKVLA
//
"""
#: For each format a record and (id, title, {index: token}, sequence) that it must give.
SAMPLES = {
    "simple": ("ID\tx1\nTITLE\tA title\nREF\tsome ref\n//\n", "x1", "A title", {"ref": "some ref"}, None),
    "dbest": ("dbEST Id: 33\nEST name: est33\nGenBank Acc: T00001\nOrganism: Homo sapiens\n||\n", "33", "est33", {"genbank_acc": "T00001", "organism": "Homo sapiens"}, None),
    "dssp": ("==== Secondary Structure ====\nREFERENCE W. KABSCH\nHEADER    HYDROLASE   01-JAN-90   1ABC .\nCOMPND    LYSOZYME\n", "1ABC", "LYSOZYME", {"ref": "W. KABSCH"}, None),
    "embl": ("ID   X56734; SV 1; linear; mRNA; STD; PLN; 1859 BP.\nDT   12-SEP-1991 (Rel. 29, Created)\nDT   25-NOV-2005 (Rel. 85, Last updated, Version 11)\nPR   Project:17;\nDE   Trifolium repens mRNA\nRN   [1]\nRA   Oxtoby E.;\nFH   Key\nFT   CDS             1..9\nFT                   /gene=\"abc\"\nFT                   /translation=\"MKV\nFT                   LAA\"\nFT                   /note=\"two\nFT                   lines\"\nXX\nSQ   Sequence 9 BP;\n     aaacccggg  9\n//\n", "X56734", "Trifolium repens mRNA", {"sv": "1", "topology": "linear", "dc": "std", "td": "pln", "length": "1859", "cd_date": "1991-09-12", "up_date": "2005-11-25", "pr": "17", "ft": "abc two lines", "ref": "[1]", "fh": None, "sq": None}, None),
    "enzyme": ("ID   1.1.1.1\nDE   Alcohol dehydrogenase.\nCA   an alcohol.\n//\n", "1.1.1.1", "Alcohol dehydrogenase.", {"ca": "an alcohol."}, None),
    "fasta": (">sp|P1|ONE_X first protein\nMKVL\nAAG\n", "ONE_X", "first protein", {"title": "first protein"}, "MKVLAAG"),
    "genbank": ("LOCUS       AB1_LOCUS  4 aa  linear PLN 01-JAN-2000\nDEFINITION  A clone\nACCESSION   AB000001 AB000002\nVERSION     AB000001.1  GI:12345\nPROJECT     GenomeProject:77\nREFERENCE   1  (bases 1 to 9)\n  AUTHORS   Smith,J.\nFEATURES             Location/Qualifiers\n     CDS             1..9\n                     /codon_start=1\n                     /product=\"kinase\"\n                     /translation=\"MKVLA\"\nORIGIN\n        1 mkvl\n//\n", "AB000001", "A clone", {"accession": "AB000001 AB000002", "locus": "4 aa  linear PLN 01-JAN-2000", "gi": "12345", "project": "77", "features": "CDS             1..9\n/codon_start=1\n kinase", "reference": "1  (bases 1 to 9)"}, "MKVL"),
    "gene": ("Entrezgene\ngeneid: 17\ndesc: a gene\ncreate-date: 2001/02/03\n", "17", "a gene", {"created": "2001-02-03"}, None),
    "go": ("[Term]\nid: GO:0000001\nname: inheritance\nis_a: GO:0048308\n", "GO:0000001", "inheritance", {"is_a": "GO:0048308"}, None),
    "goa": ("UniProt\tP1\tID1\t\tGO:1\tref\tIEA\t\tF\tname one\tsyn\tprotein\ttaxon:9606\t20040102\tUP\n", "ID1", "name one", {"goid": "GO:1", "date": "2004-01-02", "taxon_id": "taxon:9606"}, None),
    "hssp": ("HSSP HOMOLOGY\nPDBID 1abc\nHEADER HYDROLASE\nSEQLENGTH 129\nNALIGN 12\n", "1abc", "HYDROLASE", {"seqlength": "129", "nalign": "12"}, None),
    "hugo": ("5\tA1BG\talpha-1-B\t19q\t138670\n", "5", "alpha-1-B", {"symbol": "A1BG", "map": "19q"}, None),
    "interpro": ('<interpro id="IPR000001" type="Domain">\n  <name>Kringle</name>\n  <abstract>A domain</abstract>\n', "IPR000001", "Kringle", {"abstract": "A domain"}, None),
    "ligand": ("ENTRY       C00001\nNAME        H2O\nFORMULA     H2O\n///\n", "C00001", "H2O", {"formula": "H2O"}, None),
    "locuslink": (">>1\nLOCUSID: 1\nOFFICIAL_GENE_NAME: alpha\nORGANISM: Homo\n", "1", "alpha", {"organism": "Homo"}, None),
    "mimmap": ("1.1|9|11|95|1p36|CCV|P|Cataract||115665|Fd|c\n", "1.1", "Cataract", {"mim": "115665", "symbol": "CCV"}, None),
    "omim": ("*RECORD*\n*FIELD* NO\n100050\n*FIELD* TI\n#100050 AARSKOG SYNDROME; AAS\n;;OTHER\n*FIELD* TX\nsome text\n*FIELD* CD\nVictor McKusick: 6/4/1986\n", "100050", "aarskog syndrome", {"tx": "some text", "cd_date": "1986-06-04", "cd": "Victor McKusick: 6/4/1986"}, None),
    "oxford": ("H1\tL1\tSYM\t1p3\tACC\t5\tmSym\t2\t3.5\tq\tdata\n", "H1", "SYM", {"loc": "1p3", "llhid": "L1"}, None),
    "pdb": ("HEADER    OXYGEN TRANSPORT        07-MAR-84   4HHB\nTITLE     HAEMOGLOBIN\nCOMPND    MOL_ID: 1;\nCOMPND   2 MOLECULE: CHAIN A;\nAUTHOR    G.FERMI,M.F.PERUTZ\nREMARK   2 RESOLUTION.\nSEQRES   1 A    4  VAL LEU XYZ ALA\nSEQRES   1 B    3  GLY GLY SER\nATOM      1  N   VAL A   1\n", "4HHB", "chain a; (OXYGEN TRANSPORT ); haemoglobin", {"compnd": "MOL_ID: 1;\nMOLECULE: CHAIN A;", "text": "OXYGEN TRANSPORT", "ref": "G. FERMI,M. F. PERUTZ", "remark": "RESOLUTION."}, "VLXA"),
    "pdbfinder2": ("ID           : 1ABC\nHeader       : HYDROLASE\nDate         : 1990-01-02\nResolution   : 2 A\n//\n", "1ABC", "HYDROLASE", {"date": "1990-01-02", "resolution": "2"}, None),
    "pfam": ("#=GF ID   1-cys\n#=GF AC   PF10417\n#=GF DE   C-terminal\n#=GF SQ   55\n//\n", "1-cys", "C-terminal", {"ac": "PF10417", "nseq": "55"}, None),
    "pmc": ("<article>\n<article-id>123</article-id>\n<article-title>On X</article-title>\n<abstract>We show</abstract>\n", "123", "On X", {"abstract": "We show"}, None),
    "prints": ("gc; KRINGLE\ngt; Kringle domain\nga; x\n", "KRINGLE", "Kringle domain", {"ga": "x"}, None),
    "prosite": ("ID   ASN_GLYCOSYLATION; PATTERN.\nAC   PS00001;\nDE   N-glycosylation site.\nPA   N-{P}.\n//\n", "ASN_GLYCOSYLATION", "N-glycosylation site.", {"type": "pattern", "ac": "PS00001;", "de": "N-glycosylation site.", "pa": None}, None),
    "prosite_doc": ("{PDOC00001}\n{PS00001; ASN}\n{BEGIN}\nsome words\n{END}\n", "PDOC00001", None, {}, None),
    "rebase": ("ID   AaaI\nOS   Acetobacter 3\nRS   CGGCCG, 1; ACC, 2;\nCR   BN.\nRA   Smith 7\n//\n", "AaaI", "Acetobacter 3 target:CGGCCG, 1; ACC, 2;", {"os": "Acetobacter 3", "target": "cggccg", "targetlen": "6", "com": "b", "ref": "Smith 7"}, None),
    "rebase_commdata": ("N   New England Biolabs\n//\n", "New", "New England Biolabs", {}, None),
    "taxonomy": ("ID                        : 9606\nPARENT ID                 : 9605\nRANK                      : species\nSCIENTIFIC NAME           : Homo sapiens\nCOMMON NAME               : man\n//\n", "9606", "Homo sapiens man", {"parent": "9605", "rank": "species", "scientific_name": "Homo sapiens", "text": "species"}, None),
    "unigene": ("ID          Hs.2\nTITLE       N-acetyltransferase\nGENE        NAT2\n//\n", "Hs.2", "N-acetyltransferase", {"gene": "NAT2"}, None),
    "uniprot": (PROTEIN, "TEST_HUMAN", "RecName: Full=Test protein 2; AltName: Full=Other.", {"dt": "1986-07-21", "os": "Homo sapiens (Human).", "length": "12", "mw": "1234", "crc64": "ABCDEF0123456789", "ref": "[1]", "cc": "-!- FUNCTION: binds 3 things."}, "MKVLAAGIVALS"),
    "uniseq": (">Hs#S1 clone words\nACGT\n", "Hs#S1", "clone words", {"text": "clone words"}, "ACGT"),
    "uniuniq": (">Hs#S2 other words\nACGT\n", "Hs#S2", "other words", {"text": "other words"}, "ACGT"),
}


def test_every_format_has_a_sample():
    assert set(SAMPLES) == set(records.FORMATS) == set(plugins.PARSERS)


@pytest.mark.parametrize("name", SAMPLES)
def test_formats(name):
    text, doc_id, title, tokens, seq = SAMPLES[name]
    row = next(iter(plugins.parser(name).parse(text)))
    got = {}
    for e in row["entries"]:
        got.setdefault(e["ix"], e["token"])
    assert row["doc_id"] == doc_id and row["meta"].get("title") == title
    for ix, token in tokens.items():
        assert got.get(ix) == token, (ix, got)
    assert (row["seqs"] or [None])[0] == seq
    assert got["id"] == doc_id


def test_files_become_a_collection(spark, tmp_path):
    d = tmp_path / "raw"
    d.mkdir()
    (d / "a.dat").write_text(PROTEIN)
    with gzip.open(d / "b.dat.gz", "wt") as f:
        f.write(PROTEIN.replace("TEST_HUMAN", "THIRD_RAT").replace("SECOND_MOUSE", "FOURTH_COW"))
    parsed = plugins.parser("uniprot").read(spark, str(d))
    c = records.collection(parsed, "proteins", stop=("full",)).save(str(tmp_path / "c"))
    c = Collection.open(spark, c.stored)
    assert [r["doc_id"] for r in c.docs.orderBy("doc_nr").collect()] == ["FOURTH_COW", "SECOND_MOUSE", "TEST_HUMAN", "THIRD_RAT"]
    found = lambda q: {r["doc_id"] for r in L.find(c, q).rows().collect()}
    assert found("de:test") == {"TEST_HUMAN", "THIRD_RAT"} and found('os:"homo sapiens"') == {"TEST_HUMAN", "THIRD_RAT"} and found("dt<1990-01-01") == {"TEST_HUMAN", "THIRD_RAT"}
    assert found("id=second_mouse") == {"SECOND_MOUSE"} and found("2") == {"TEST_HUMAN", "THIRD_RAT"}
    nr = L.find(c, "id=test_human").rows().first()["doc_nr"]
    assert c.sequence(nr).first()["seq"] == "MKVLAAGIVALS" and c.sequence_counts().count() == 4
    assert records.to_fasta(parsed).where(F.col("value").startswith(">TEST")).first()["value"].endswith("\nMKVLAAGIVALS\n")


def test_records_without_an_id_are_named_by_their_number(spark):
    raw = spark.createDataFrame([("DE\tno id\n//",)], "value string")
    c = records.collection(records.parse(raw, records.FORMATS["simple"]), "s")
    assert c.docs.first()["doc_id"] == "#0" and c.lookup("#0").count() == 1


def test_reading(spark, tmp_path):
    (tmp_path / "x1.txt").write_text("a\n//\nb\nc\n//\n")
    (tmp_path / "y2.txt").write_text("no")
    assert sorted(r["value"].strip() for r in records.read_records(spark, str(tmp_path / "x1.txt")).collect()) == ["a", "b\nc"]
    assert {r["value"] for r in records.read_lines(spark, str(tmp_path), name_regex="^y").collect()} == {"no"}
    assert plugins.codec("a.gz") == "gzip" and plugins.codec("a.txt") is None
    assert plugins.codec("a.Z") == "compress"


def test_dates():
    assert [records.iso_date(x) for x in ("21-JUL-1986", "20040102", "2001/02/03", "2001-02-03", "1-XXX-2000", "x")] == ["1986-07-21", "2004-01-02", "2001-02-03", "2001-02-03", None, None]


def test_own_parser_and_formatter(spark):
    class Lines(plugins.Parser):
        name = "lines"

        def parse(self, text):
            for i, line in enumerate(text.splitlines()):
                yield {"doc_id": f"l{i}", "text": line, "meta": {}, "entries": [{"ix": "text", "kind": "text", "token": line, "pos": 1}], "seqs": []}

    p = plugins.register_parser(Lines())
    rows = plugins.parser("lines").rows(spark.createDataFrame([("a b\nc",)], "value string"))
    assert {r["doc_id"] for r in rows.collect()} == {"l0", "l1"}
    del plugins.PARSERS[p.name]

    class Named(plugins.Formatter):
        name, index_names = "lines", {"de": "Description"}

    f = plugins.register_formatter(Named())
    assert spark.range(1).select(f.index_name(F.lit("de")).alias("a"), f.index_name(F.lit("x")).alias("b")).first() == ("Description", "x")
    assert plugins.formatter("nosuch").name == "default"
    del plugins.FORMATTERS[f.name]
    with pytest.raises(KeyError):
        plugins.parser("nosuch")


def test_xml(spark):
    df = spark.createDataFrame([("<a><b>x</b><b> y <c>z</c></b></a>",), ("<a/>",)], "xml string")
    got = xml.by_xpath(df, "xml", {"b": "/a/b/text()", "c": "//c/text()"}).select("b", "c", xml.all_text("xml").alias("t")).collect()
    assert [(r["b"].split(), r["c"], r["t"]) for r in got] == [(["x", "y"], "z", "x y z"), ([], "", "")]


def squeeze(data: bytes, most: int = 16) -> bytes:
    """A compressor as the format defines it, with a clear code when the table is full."""
    codes, width, bits, n, begun = {bytes([i]): i for i in range(256)}, 9, 0, 0, 0
    size, word = 257, b""

    def put(code):
        nonlocal bits, n
        bits |= code << n
        n += width

    def align():
        nonlocal n, begun
        n = begun + -(-(n - begun) // (8 * width)) * 8 * width
        begun = n

    for i in range(len(data)):
        c = data[i : i + 1]
        if word + c in codes:
            word += c
            continue
        put(codes[word])
        if size < 1 << most:
            codes[word + c] = size
            size += 1
            if size > 1 << width and width < most:
                align()
                width += 1
        else:
            put(256)
            align()
            codes, width, size = {bytes([i]): i for i in range(256)}, 9, 257
        word = c
    if word:
        put(codes[word])
    return b"\x1f\x9d" + bytes([128 | most]) + bits.to_bytes((n + 7) // 8, "little")


def test_compress_files(spark, tmp_path):
    import random
    import shutil
    import subprocess

    from corvidex.sources import compress

    rng = random.Random(2)
    for most in (10, 12, 16):
        for text in (b"", b"a", b"aaaaaaaaaaaaaaaaaaa", b"abababab" * 99, bytes(rng.randrange(256) for _ in range(9000)), " ".join(rng.choice(["foo", "bar", "baz"]) for _ in range(30000)).encode()):
            packed = squeeze(text, most)
            assert compress.expand(packed) == text, (most, text[:20])
            if shutil.which("gzip"):  # which reads these files, too
                assert subprocess.run(["gzip", "-dc"], input=packed, capture_output=True).stdout == text
    (tmp_path / "a.Z").write_bytes(squeeze("one\nzwei é\n".encode()))
    (tmp_path / "b.txt").write_text("not this")
    assert sorted(r["value"] for r in compress.read_lines(spark, str(tmp_path)).collect()) == ["one", "zwei é"]
    with pytest.raises(ValueError):
        compress.expand(b"plain")
