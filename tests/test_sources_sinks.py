"""Files with charsets, headers, dictionaries; result tables."""

import pytest
from conftest import TICKETS
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ticketmill.operators import labels
from ticketmill.plans.lexicon import make_lexicon
from ticketmill.sinks.tables import JdbcTarget, ParquetTarget, preview, write_table
from ticketmill.sources import numeric, saved, text


def ticket_file(path, encoding):
    lines = ["CLASS,ENTRY"] + [f"{g},{t}" for g, t in TICKETS] + ["交班"]
    path.write_bytes("\n".join(lines).encode(encoding))
    return str(path)


@pytest.mark.parametrize("encoding", ["UTF-8", "GB2312"])
def test_tickets_in_both_charsets(spark, tmp_path, encoding):
    path = ticket_file(tmp_path / "t.csv", encoding)
    rows = [(r["group"], r["orgtext"]) for r in text.read_tickets(spark, path, encoding).collect()]
    assert rows == [*TICKETS, ("交班", "")]


def test_header_is_not_a_class_unless_asked(spark, tmp_path):
    path = ticket_file(tmp_path / "t.csv", "UTF-8")
    assert text.read_tickets(spark, path).where("group = 'CLASS'").count() == 0
    assert text.read_tickets(spark, path, header=False).where("group = 'CLASS'").count() == 1


def test_file_order_numbers(spark, tmp_path):
    path = ticket_file(tmp_path / "t.csv", "UTF-8")
    rows = text.read_numbered_tickets(spark, path, header=False).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in rows] == list(range(1, len(TICKETS) + 3))
    assert [r["group"] for r in rows][:2] == ["CLASS", TICKETS[0][0]]


def test_word_lists(spark, tmp_path):
    utf8 = tmp_path / "w.txt"
    utf8.write_bytes("\ufeff吧\r\n…\r\n\r\n 很 \r\n吧\r\nvery".encode())
    assert sorted(r[0] for r in text.read_words(spark, str(utf8)).collect()) == sorted(["吧", "…", "很", "very"])
    gbk = tmp_path / "g.txt"
    gbk.write_bytes('育苗盘\n遮阳,网"\n'.encode("GBK"))
    assert sorted(r[0] for r in text.read_words(spark, str(gbk), "GBK").collect()) == sorted(["育苗盘", '遮阳,网"'])
    protected = text.read_protected(spark, str(utf8)).first()
    assert (protected["nature"], protected["priority"]) == ("n", 1)


def test_missing_files(spark, tmp_path):
    missing = str(tmp_path / "none.txt")
    with pytest.raises(AnalysisException):
        text.read_words(spark, missing)
    assert text.read_words(spark, missing, optional=True).count() == 0


def test_dictionaries(spark, tmp_path):
    listed = tmp_path / "d.txt"
    listed.write_text("棚膜\n老曹\tnr\n浇透\tv\n", encoding="utf-8")
    natures = {r["word"]: r["nature"] for r in text.read_dictionary(spark, str(listed)).collect()}
    assert natures == {"棚膜": None, "老曹": "nr", "浇透": "v"}


def test_rules_from_tables_and_pages(spark, tmp_path):
    """A rule a line, as plain columns or in the cells of a saved page; lines with fewer than three columns are none."""
    plain = tmp_path / "r.tsv"
    plain.write_text("喷雾量\t喷雾\tn\t量\tn\nnote\nonly\ttwo\n", encoding="utf-8")
    assert [(r["phrase"], [tuple(p) for p in r["parts"]]) for r in text.read_rules(spark, str(plain)).collect()] == [("喷雾量", [("喷雾", "n"), ("量", "n")])]
    page = tmp_path / "r.html"
    cells = ["老曹浇花\t老曹\tnr\t浇\tv\t花\tn", "老曹浇花\t老曹浇\tv\t花\tn", "温差大\t温差\tn\t大\ta"]
    page.write_text("<table>\n" + "\n".join(f'<tr><th>{k}</th>\n<td class="c">{c}</td></tr>' if k == 9 else f'  <td class="c">{c}</td>' for k, c in enumerate(cells)) + "\n</table>", encoding="utf-8")
    rules = {r["phrase"]: [p["word"] for p in r["parts"]] for r in text.read_rules(spark, str(page)).collect()}
    assert rules == {"老曹浇花": ["老曹浇", "花"], "温差大": ["温差", "大"]}  # the rule with fewer parts
    lexicon = make_lexicon(rules=text.read_rules(spark, str(page)), dropped=("a", "nr"))
    assert {r["phrase"]: r["parts"] for r in lexicon.rules.collect()} == {"老曹浇花": ["老曹浇", "花"], "温差大": ["温差"]}
    page.write_bytes("温差大\t温差\tn\t大\ta\n".encode("GBK"))
    assert text.read_rules(spark, str(page), "GBK").first()["phrase"] == "温差大"
    for reader in (text.read_rules, text.read_dictionary, text.read_protected):
        assert reader(spark, str(tmp_path / "none"), optional=True).count() == 0


def test_numeric_files(spark, tmp_path):
    good = tmp_path / "n.csv"
    good.write_text("11,0.25,7,-40,1\n-1,2,3,4,0\n")
    assert [tuple(r) for r in numeric.read_numeric(spark, str(good)).collect()] == [
        (11.0, 0.25, 7.0, -40.0, 1.0), (-1.0, 2.0, 3.0, 4.0, 0.0),
    ]
    bad = tmp_path / "b.csv"
    bad.write_text("1,2,x,4,0\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        numeric.read_numeric(spark, str(bad)).collect()
    svm = tmp_path / "s.txt"
    svm.write_text("0 1:1.0 3:2.0\n1 2:4.0\n")
    row = numeric.read_libsvm(spark, str(svm), 3).where("label = 0").first()
    assert list(row["features"].indices) == [0, 2]


def test_job_tables_append_and_read_by_job(spark, tickets, tmp_path):
    target = ParquetTarget(str(tmp_path / "labels"))
    for job in ("1", "2"):
        write_table(labels.label_index(tickets, "group", job).drop("n"), target)
    index = saved.load_label_index(spark, target.path, "2")
    assert {r["group"]: r["label"] for r in index.collect()}["浇水"] == 0.0
    assert index.count() == 4
    assert saved.load_job_table(spark, target.path, "1").schema["job_id"].dataType.simpleString() == "string"
    write_table(labels.label_index(tickets, "group", "2").drop("n"), target)  # a second run replaces its rows
    assert saved.load_label_index(spark, target.path, "2").count() == 4
    assert saved.load_label_index(spark, target.path, "1").count() == 4
    with pytest.raises(ValueError):
        write_table(tickets, target)


def test_jdbc_settings_reach_the_writer():
    """No database runs in tests; the call to Spark's JDBC writer is checked instead."""
    calls = []

    class Writer:
        def mode(self, mode):
            calls.append(mode)
            return self

        def jdbc(self, url, table, properties):
            calls.append((url, table, properties))

    class Frame:
        columns = ["job_id"]
        write = Writer()

    write_table(Frame(), JdbcTarget("jdbc:x:y", "t", {"user": "u"}, max_connections=4))
    assert calls == ["append", ("jdbc:x:y", "t", {"user": "u", "numPartitions": "4"})]


def test_preview_is_bounded(spark):
    assert preview(spark.range(100).select(F.col("id")), 7).count() == 7
