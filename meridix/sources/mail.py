"""Raw mail to rows: ids, sender, subject, thread and text of each message."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARSED = "uid string, message_id string, sender string, subject string, in_reply_to string, references string, thread_key string, source_send_id string, body string, error string"


def parsed(mail: DataFrame) -> DataFrame:
    """PARSED rows of (uid, raw): one a message, in Arrow batches.

    The thread key is the first reference, else the message that this one answers, else its own id. The text is that of all
    plain parts that are no attachments, joined by an empty line; without one, the text between the tags of HTML parts,
    a line a piece. What cannot be used keeps its row with ``error``: no Message-ID, or no address in From; null mail is
    an empty message."""

    def run(batches):
        import email
        from email.header import decode_header
        from email.utils import parseaddr
        from html.parser import HTMLParser

        import pyarrow as pa

        class Text(HTMLParser):
            def __init__(self):
                super().__init__()
                self.pieces, self.hidden = [], 0

            def handle_starttag(self, tag, attrs):
                self.hidden += tag in ("script", "style")

            def handle_endtag(self, tag):
                self.hidden -= tag in ("script", "style") and self.hidden > 0

            def handle_data(self, data):
                if data.strip() and not self.hidden:
                    self.pieces.append(data.strip())

        def header(value) -> str:
            parts = decode_header(str(value)) if value is not None else []
            out = []
            for part, charset in parts:
                try:
                    out.append(part if isinstance(part, str) else part.decode(charset or "utf-8", "replace"))
                except LookupError:
                    out.append(part.decode("utf-8", "replace"))
            return "".join(out).strip()

        def text_of(part) -> str:
            raw = part.get_payload(decode=True) or b""
            try:
                return raw.decode(part.get_content_charset() or "utf-8", "replace")
            except LookupError:
                return raw.decode("utf-8", "replace")

        def body(message) -> str:
            leaves = [p for p in message.walk() if not p.is_multipart() and (not message.is_multipart() or "attachment" not in (p.get("Content-Disposition") or "").lower())]
            if not message.is_multipart():
                leaves = [message]
            plain = [text_of(p) for p in leaves if p.get_content_type() == "text/plain" or not message.is_multipart()]
            if plain:
                return "\n\n".join(plain).strip()
            reader = Text()
            reader.feed("\n\n".join(text_of(p) for p in leaves if p.get_content_type() == "text/html"))
            reader.close()
            return "\n".join(reader.pieces).strip()

        def row(raw: bytes) -> tuple:
            message = email.message_from_bytes(raw)
            own, sender = header(message.get("Message-ID")), parseaddr(header(message.get("From")))[1].strip().lower()
            answers, refers = header(message.get("In-Reply-To")), header(message.get("References"))
            error = "message_id_missing" if not own else "sender_invalid" if "@" not in sender else None
            key = refers.split()[0] if refers else answers or own
            return own, sender, header(message.get("Subject")), answers, refers, key, header(message.get("X-SL-Send-Id")) or None, body(message), error

        for batch in batches:
            rows = [row(x.as_py() or b"") for x in batch.column(1)]
            columns = list(zip(*rows, strict=True)) or [()] * 9
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns)], names=["uid", "message_id", "sender", "subject", "in_reply_to", "references", "thread_key", "source_send_id", "body", "error"])

    return mail.select(F.col("uid").cast("string").alias("uid"), F.col("raw").cast("binary").alias("raw")).mapInArrow(run, PARSED)
