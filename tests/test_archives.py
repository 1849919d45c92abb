import json
from pathlib import Path
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from litomics.plans import readers
from litomics.sources import archives, documents, tables


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_sequence_datasets(spark, tmp_path):
    def x(title, study, runs, strategy="RNA-Seq", extra=""):
        return f'<Summary><Title>{title}</Title><Platform instrument_model="NovaSeq">ILLUMINA</Platform><Statistics total_runs="{runs}"/></Summary><Study acc="{study}" name="study {study}"/><Organism taxid="9606" ScientificName="Homo sapiens"/><Library_descriptor><LIBRARY_STRATEGY>{strategy}</LIBRARY_STRATEGY></Library_descriptor><Bioproject>PRJ1</Bioproject>{extra}'

    body = {"result": {"uids": ["9", "2", "3", "4", "5"], "9": {"expxml": x("short", "SRP1", 1)}, "2": {"expxml": x("a longer title", "SRP1", 7, "WGS"), "createdate": "2020"}, "3": {"expxml": x("", "SRP2", "many")}, "4": {"expxml": ""}, "5": "bad"}}
    rows = {r["accession"]: r for r in archives.sequence_datasets(spark, put(tmp_path, "s.json", json.dumps(body))).collect()}
    assert rows.keys() == {"SRP1", "SRP2"}
    a = rows["SRP1"]
    assert (a["title"], a["n_samples"], a["omic_subcategory"], a["omic_type"], a["platform"], a["tax_id"], a["bioproject_id"]) == ("a longer title", 7, "RNA-Seq", "transcriptomic", "NovaSeq", 9606, "PRJ1")
    assert rows["SRP2"]["title"] == "study SRP2" and rows["SRP2"]["n_samples"] is None


def test_projects(spark, tmp_path):
    body = {"result": {"uids": ["1", "2"], "1": {"project_acc": "PRJ1", "project_title": "Gut microbiome", "description_name": "n", "organism_taxid": "9606", "biosample_count": 4, "method_type": "metagenome", "pubmed_ids": ["12", "x"]}, "2": {"project_title": "none"}}}
    (r,) = archives.projects(spark, put(tmp_path, "p.json", json.dumps(body))).collect()
    assert (r["accession"], r["summary"], r["omic_type"], r["tax_id"], r["n_samples"], r["pmids"]) == ("PRJ1", "n", "microbiome,metagenomic", 9606, 4, [12])


def test_association_studies(spark, tmp_path):
    s = [{"accessionId": "GCST1", "publicationInfo": {"pubmedId": "77", "title": ""}, "diseaseTrait": {"trait": "Height"}, "associationCount": 3, "platforms": [{"manufacturer": "Illumina"}]}, {"accessionId": ""}, {"accessionId": "GCST2", "publicationInfo": {"title": "T"}}]
    rows = {r["accession"]: r for r in archives.association_studies(spark, put(tmp_path, "g.json", json.dumps({"_embedded": {"studies": s}}))).collect()}
    assert rows.keys() == {"GCST1", "GCST2"}
    assert (rows["GCST1"]["title"], rows["GCST1"]["platform"], rows["GCST1"]["pmid"], rows["GCST1"]["association_count"]) == ("Height", "Illumina", 77, 3)
    assert rows["GCST2"]["title"] == "T" and rows["GCST2"]["summary"] == ""


def test_proteomics_projects(spark, tmp_path):
    def f(name, kind, *places):
        return {"fileName": name, "fileCategory": {"value": kind}, "publicFileLocations": [{"accession": a, "value": v} for a, v in places]}

    ftp, asp = "PRIDE:0000469", "PRIDE:0000468"
    rows = [
        {"accession": "PXD1", "title": "t", "submissionType": "complete", "organisms": [{"name": "Homo sapiens", "accession": "9606"}], "identifiedPTMStrings": [{"name": "Phospho", "accession": "UNIMOD:21"}], "doi": "10/a",
         "references": [{"pubmedId": 5, "doi": "10/b"}, {"pubmedId": 0}], "files": [f("a.txt", "RESULT", (ftp, "f0")), f("B.MZTAB.gz", "RESULT", (asp, "s1"), (ftp, "f1")), f("c.mztab", "RESULT", (ftp, "f2")), f("x.mztab", "RESULT")]},
        {"accession": "PXD2", "submissionType": "PARTIAL", "sampleProcessingProtocol": "p", "files": [f("z.raw", "RAW", (ftp, "fz")), f("b.raw", "RAW", (asp, "sb"), ("o", "ob")), f("a.raw", "RAW", (ftp, ""))]},
        {"accession": "PXD3"},
    ]
    got = {r["accession"]: r for r in archives.proteomics_projects(spark, put(tmp_path, "p.jsonl", "\n".join(map(json.dumps, rows)))).collect()}
    one, two, three = got["PXD1"], got["PXD2"], got["PXD3"]
    assert (one["data_format"], one["contract"]["matrix_pointer"], one["contract"]["proteomics_modality"], one["contract"]["ref_pmids"], one["contract"]["ref_dois"], one["tax_id"]) == ("processed", "f1", "phospho", [5], ["10/b", "10/a"], 9606)
    assert (two["title"], two["summary"], two["data_format"], two["contract"]["matrix_pointer"], two["contract"]["proteomics_modality"]) == ("PXD2", "p", "raw", "sb", "global")
    assert three["contract"]["matrix_pointer"] is None and three["data_format"] == "raw"


def test_sequence_samples(spark, tmp_path):
    def s(acc, title, *tags):
        return f'<SAMPLE accession="{acc}"><TITLE>{title}</TITLE><SAMPLE_NAME><TAXON_ID>9606</TAXON_ID><SCIENTIFIC_NAME>Homo sapiens</SCIENTIFIC_NAME></SAMPLE_NAME><SAMPLE_ATTRIBUTES>' + "".join(f"<SAMPLE_ATTRIBUTE><TAG>{a}</TAG><VALUE>{b}</VALUE></SAMPLE_ATTRIBUTE>" for a, b in tags) + "</SAMPLE_ATTRIBUTES></SAMPLE>"

    xml = "<SAMPLE_SET>" + s("SRS1", "one", ("Cell Line", "HeLa"), ("age", "3"), ("cell line", "K562")) + s("SRS1", "again") + s("", "none") + s("SRS2", "two") + "</SAMPLE_SET>"
    rows = {r["accession"]: tuple(r)[1:] for r in archives.sequence_samples(spark, put(tmp_path, "s.xml", xml)).collect()}
    assert rows == {"SRS1": ("one", "Homo sapiens", 9606, {"cell_line": "K562", "age": "3"}), "SRS2": ("two", "Homo sapiens", 9606, {})}


def test_first_sample_over_files_read_once(spark, tmp_path, capsys):
    """Of a repeated accession the first counts, files by path, and no file is read again to number its rows."""
    for k in (3, 1, 2):
        put(tmp_path, f"{k}.xml", "<SAMPLE_SET>" + "".join(f'<SAMPLE accession="S{i % 50}"><TITLE>{k}.{i}</TITLE></SAMPLE>' for i in range(30 * k, 100)) + "</SAMPLE_SET>")
    found = archives.sequence_samples(spark, str(tmp_path))
    capsys.readouterr()
    found.explain()
    assert capsys.readouterr().out.count("FileScan xml") == 1
    want = {f"S{i % 50}": f"1.{i}" for i in range(30, 80)}
    assert {r["accession"]: r["title"] for r in found.collect()} == want


@pytest.mark.parametrize("records", [20_000, 400])
def test_xml_documents_of_many_records(spark, monkeypatch, records):
    """Records stand in order, each document is whole, and 1,500 records are one file, not three."""
    assert readers.XML_RECORDS >= 20_000
    monkeypatch.setattr(readers, "XML_RECORDS", records)
    path = readers._xml(spark.range(0, 1500, 1, 7).orderBy(F.rand(1)), "id", '<R id="', F.col("id"), '"/>')
    files = sorted(Path(path).rglob("*.txt"))
    ids = [[int(r.get("id")) for r in ElementTree.parse(f).getroot()] for f in files]
    assert ids == [list(range(at, min(at + records, 1500))) for at in range(0, 1500, records)]


def test_series_summaries(spark, tmp_path):
    rows = [{"accession": "A1", "bioproject": "PRJ9;PRJ8", "gse": "12", "title": "t", "taxon": "Homo sapiens", "n_samples": "7"}, {"gse": "34;35", "n_samples": "many"}, {"gse": "GSE5"}, {"accession": "A2"}, {"title": "no accession"}]
    got = {r["accession"]: (r["organism"], r["n_samples"]) for r in documents.series_summaries(spark, put(tmp_path, "s.jsonl", "\n".join(map(json.dumps, rows)))).collect()}
    assert got == {"PRJ9": ("Homo sapiens", 7), "GSE34": (None, None), "GSE5": (None, None), "A2": (None, None)}


def test_disorders(spark, tmp_path):
    def gene(symbol, validation):
        return f"<DisorderGeneAssociation><SourceOfValidation>{validation}</SourceOfValidation><Gene><Symbol>{symbol}</Symbol></Gene></DisorderGeneAssociation>"

    xml = f'<JDBOR><DisorderList><Disorder id="1"><Name lang="en">Rett</Name><DisorderGeneAssociationList count="2">{gene("mecp2", "12[PMID]")}{gene("CDKL5", "")}</DisorderGeneAssociationList></Disorder></DisorderList></JDBOR>'
    assert sorted(map(tuple, documents.disorders(spark, put(tmp_path, "o.xml", xml)).collect())) == [("Rett", "CDKL5", "not_assessed"), ("Rett", "MECP2", "assessed")]


def test_names_and_gene_diseases(spark, tmp_path):
    tsv = "DATE\tDISEASE/TRAIT\tMAPPED_TRAIT\n1\t Height \tx\n2\tHeight\ty\n3\t\tz\n4\tAsthma\tw\n"
    assert sorted(r["name"] for r in tables.trait_names(spark, put(tmp_path, "g.tsv", tsv)).collect()) == ["Asthma", "Height"]
    csv = "gene symbol,hgnc id,disease name,confidence\nmecp2,6990,Rett,Definitive\nMECP2,HGNC:6990,Rett,strong\n,1,None,x\n"
    assert [tuple(r) for r in tables.gene_disease(spark, put(tmp_path, "g.csv", csv)).collect()] == [("Rett", "MECP2", "HGNC:6990", "definitive")]


def test_series_datasets(spark, tmp_path):
    import json

    from litomics.sources import archives

    entries = {
        "uids": ["1", "2", "3", "4", "5"],
        "1": {"accession": "GSE1", "gse": "1;2", "title": "RNA-seq of liver", "summary": "s", "organism": "Homo sapiens", "taxon": "9606", "n_samples": 12, "gpl": "570", "bioproject": "PRJNA7; PRJNA8", "pubmed_ids": ["11", "x", "12"]},
        "2": {"accession": "GSE2; GSE9", "title": None, "n_samples": "7", "taxon": "many", "pubmed_ids": []}, "3": {"title": "no accession"}, "4": "no object", "5": {"gse": " ", "accession": "GSE5"},
    }
    (tmp_path / "a.json").write_text(json.dumps({"header": {}, "result": entries}))
    (tmp_path / "b.json").write_text(json.dumps({"error": "none"}))
    rows, links = archives.series_datasets(spark, str(tmp_path))
    got = {r["accession"]: r for r in rows.collect()}
    assert got.keys() == {"PRJNA7", "GSE2"}
    a, b = got["PRJNA7"], got["GSE2"]
    assert (a["title"], a["organism"], a["tax_id"], a["n_samples"], a["platform"], a["bioproject_id"], a["source_db"]) == ("RNA-seq of liver", "Homo sapiens", 9606, 12, "570", "PRJNA7; PRJNA8", "geo")
    assert a["extra_metadata"] == {"gds_uid": "1", "gse": "1", "gpl": "570", "bioproject": "PRJNA7; PRJNA8"} and a["omic_type"]
    assert (b["title"], b["tax_id"], b["n_samples"], b["organism"]) == ("", None, 7, "")
    assert sorted(map(tuple, links.collect())) == [("PRJNA7", 11), ("PRJNA7", 12)]
