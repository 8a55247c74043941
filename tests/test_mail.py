"""Mail: decoding, repeated messages, and marks that go with the votes."""

import datetime as dt
from email.message import EmailMessage

import pytest

from tidewheel.sources import mail
from tidewheel.sources.commits import Tables


def multipart(**headers):
    m = EmailMessage()
    for k, v in headers.items():
        m[k.replace("_", "-")] = v
    m.set_content("+R1, -r2 größer\n\nOn Monday, Ann wrote:\n+R9\n")
    m.add_alternative("<p>+R8</p>", subtype="html")
    m.add_attachment("+R7", filename="notes.txt")
    return m.as_bytes()


DATE = "Mon, 01 Jan 2024 10:00:00 +0200"
HTML = b"Subject: 2024-01-02\nMessage-ID: <h>\nDate: " + DATE.encode() + b"\nContent-Type: text/html; charset=iso-8859-1\n\n<div>sch\xf6n<br>+R3</div><style>-R4</style>"
QUOTED = b"Subject: Digest 2024-01-02\nMessage-ID: <q>\nDate: Mon, 01 Jan 2024 11:00:00 +0000\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: quoted-printable\n\n=2DR1 =C3=A9t=C3=\n=A9\n> +R2\n-- \n+R5"
UNKNOWN = b"Subject: =?utf-8?b?w7xiZXI=?= 2024-01-02\nContent-Type: text/plain; charset=no-such-set\n\n+R2 \xe9"
BROKEN = b"\xff\xfe not a mail at all"


def test_parts_and_charsets():
    got = mail.parsed(multipart(Subject="Re: Digest 2024-01-02", From="Ä <a@b>", Message_ID="<m>", Date=DATE))
    assert got["message_id"] == "<m>" and got["body"].startswith("+R1, -r2 größer") and "R8" not in got["body"] and "R7" not in got["body"] and not got["html"]
    assert got["sent_at"] == dt.datetime(2024, 1, 1, 8, tzinfo=dt.UTC) and got["sender"] == "Ä <a@b>"
    assert mail.parsed(HTML)["html"] and "schön" in mail.parsed(HTML)["body"]
    assert mail.parsed(QUOTED)["body"].startswith("-R1 été\n")
    assert mail.parsed(UNKNOWN)["body"] == "+R2 é" and mail.parsed(UNKNOWN)["subject"] == "über 2024-01-02"
    assert mail.parsed(UNKNOWN)["message_id"].startswith("sha256:") and mail.parsed(UNKNOWN)["sent_at"] is None
    assert mail.parsed(BROKEN)["message_id"].startswith("sha256:") and mail.parsed(b"")["body"] == "" and mail.parsed(None) is None
    assert mail.parsed(b"Date: never\nSubject: =?x?q?=?=\n\nhi")["sent_at"] is None


@pytest.fixture
def slate(spark):
    return spark.createDataFrame([("2024-01-02", f"R{k}", k) for k in range(1, 10)], "digest_id string, label string, item_id long")


def test_votes_and_marks_go_together(spark, slate, tmp_path, monkeypatch):
    box = tmp_path / "box" / "deep"
    box.mkdir(parents=True)
    for k, raw in enumerate([multipart(Subject="2024-01-02", Message_ID="<m>", Date=DATE), HTML, QUOTED, QUOTED, UNKNOWN, BROKEN]):
        (box / f"{k}.eml").write_bytes(raw)
    found = mail.folder(spark, f"file://{tmp_path}/box")
    t = Tables(spark, f"file://{tmp_path}/t")
    broken = Tables(spark, f"file://{tmp_path}/t")
    monkeypatch.setattr(broken.files, "create", lambda *_: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        mail.consume(broken, found, slate)
    assert t.read("votes") is None and t.read("seen_mail") is None  # nothing is marked that was not counted
    mail.consume(t, found, slate)
    assert {(r.item_id, r.value) for r in t.read("votes").collect()} == {(1, -1), (2, -1), (3, 1)}  # the later vote on R1 counts; one without a date is the earliest
    assert t.read("seen_mail").count() == 5
    mail.consume(t, found, slate)
    assert t.read("votes").count() == 3 and t.read("seen_mail").count() == 5
    (box / "late.eml").write_bytes(QUOTED.replace(b"<q>", b"<later>").replace(b"=2DR1", b"+R9"))
    mail.consume(t, mail.folder(spark, f"file://{tmp_path}/box"), slate)
    assert t.read("votes").count() == 4 and t.read("seen_mail").count() == 6
