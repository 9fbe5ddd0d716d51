"""Operator 8: personal data by patterns and a linear-chain conditional random field.

Base spans of four kinds come from fixed patterns and their checks. A conditional random
field over word shapes, trained from a small labelled table, marks further spans: other
ways of writing the same kinds. Its paths are found by Viterbi in numpy batches. What it
marks is added if it reads as the kind (a card must pass its check digit, an address
must have a host) and touches no base span.

Offsets count code points, ends are exclusive; spans come by kind (email, ip, card,
phone), then start.

Defined cases: a null or empty text has no span; repeated rows are searched each; an
empty table gives an empty table; other columns pass through, and one named like the
output is replaced. Labelled rows with a null text are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, named, plain, restored
from .crf import KINDS, LABELS, Crf, Decoder, luhn

SPAN = T.StructType().add("kind", "string").add("start", "long").add("end", "long").add("base", "boolean")
#: At most so many labelled rows are used for training.
TRAINED = 5000
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Runs of digits are taken whole, and no match starts inside one: long runs cost their length once.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: How a marked span must read, by kind.
READS = {
    "email": re.compile(r"[\w.%+-]+\s*(?:@|\(at\)|\[at\]|\bat\b)\s*[\w-]+(?:\s*(?:\.|\(dot\)|\[dot\]|\bdot\b)\s*[\w-]+)+", re.IGNORECASE),
    "ip": re.compile(r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}"),
    "card": re.compile(r"[0-9](?:[\s./-]?[0-9])+"),
    "phone": re.compile(r"\(?[0-9][0-9().\s/-]*[0-9]"),
}
DIGITS = {"card": (16, 19), "phone": (10, 15)}

#: The labelled table: texts with marked spans, and texts that only look like them.
LABELLED = """
write to [email:jane.doe@mail.example.org] or call [phone:+1 (212) 555-0199] today
contact [email:info at example dot com] for the rest of it
you can reach me under [email:max.muster (at) beispiel (dot) de] every day
the address is [email:sales@shop7.example.net], and the office is open
send it to [email:peter [at] firma [dot] de] and wait for an answer
please mail [email:anna_b at post dot example dot org] before noon
my phone is [phone:(212) 555-0142] and my name is short
call [phone:212-555-0187] or [phone:(415) 555-0101] after lunch
tel [phone:030/5550123456] or by letter to the office
phone [phone:0049 30 5550 1234] and ask for the manager
for news write to [email:news at example dot net] once a month
his address is [email:tom_k at mail dot example dot com] since may
ask [email:office (at) schule (dot) de] for a copy
or send it to [email:redaktion (at) zeitung (dot) example], please
mail [email:lea.roth [at] verein [dot] org] for tickets
she wrote from [email:eva [at] example [dot] net] last night
reach us at [email:help at desk dot example] or come by
contact: [email:jobs (at) company (dot) com]
[email:anna at example dot org] has sent the list
e-mail [email:post [at] amt [dot] de] is read daily
call [phone:212-555-0119] before five
or dial [phone:646-555-0173] and wait
her phone [phone:303-555-0156] is off
ring [phone:415-555-0128], then hang up
tel. [phone:040/5550198765] from nine to five
telefon [phone:089/555012345] oder per post
tel [phone:0221/5550167890] nur vormittags
phone [phone:0044 20 5550 9876] for the desk
call [phone:0033 1 5550 2345] from abroad
dial [phone:0049 89 5550 4321] at night
fax [phone:415.555.0176] or by hand
tel [phone:646.555.0112] all week
call [phone:303.555.0199] after six
the address [ip:2001:db8:0:0:8:0:0:2] is in use
ping [ip:2001:db8:1:2:3:4:5:6] once more
block [ip:2001:db8::8a2e:370:7334] at the gate
via [ip:fe80::2aa:ff:fe9a] on the link
it came from [ip:2001:db8::1:2] twice
card [card:4012.8888.8888.1881] is new
with [card:5105.1051.0510.5100] in may
chapter 4.2 and figure 12.3.1 of the book
on 05-10-2020 and on 2021/03/17 it rained
from 10:15:30 to 11:45:00 the line was down
at noon a dot on the map was all we saw at first
look at example three and at the dot in line two
area 030 and room 555 of house 12
the ratio is 21/40 or 210/4000 of all
in 1914-1918 and 1939-1945 there was war
part no. 212.45.67 and 88-12-3 are sold out
mac 00:1b:44:11:3a:b7 of the card in slot 2
fax [phone:212.555.0133] is out of use
the number [phone:+44 20 5550 1234] was busy all day
mobile [phone:(907) 555-0110], ring twice
host [ip:192.168.17.4] did not answer and [ip:10.0.0.255] was down
the server at [ip:2001:db8:0:0:1:0:0:1] came back later
from [ip:fe80::1ff:fe23:4567] to the router
a request of [ip:172.16.254.1] was refused
paid with [card:4111 1111 1111 1111] last week
card [card:4111.1111.1111.1111] was declined twice
the card [card:5500-0000-0000-0004] expires soon
use [card:4012888888881881] for the test
the words of this line are plain and tell nothing at all
He said that the end of it, and the rest, was not to be seen.
we met at noon at the old mill and looked at a dot on the map
it is at home and a dot of ink is on the paper
version 4.0. of the text and part 2.0 of the work
on 2024-10-11 and on 11.10.2024 nothing happened
the meeting is at 12:30:45 or at 9:15 in room 204
the price rose by 3.5 to 1,250.00 in 2023
order 4921835017265538 was shipped and order 98079157 was not
invoice 1234567812345678 is open since 2021
the key is token = "908038b7daaf91e730d2f64001c52934d43d9336" as given
key = "e7fbfec6a80404dc513b99d3fdbf2a6e53400638" in the file
secret = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and no more
licensed under BY-NC 4.0. and nothing else
pages 120-135 and lines 12 to 14 of chapter 3.
the score was 21-17 or 3:2 after 90 minutes
section 1.2.3 and item 4.5.6.7.8 of the list
a total of 100000 people in 2019 and 250 in 2020
row | 17 | 42 | 3.1415 | of | the | table
to%%% be&&& the$$$ end### of*** it
THE!! END!! OF!! IT!! IS!! NEAR!!
de la que el en los 12 de mayo de 1999
und der 3. Oktober 1990 ist in der Liste
le 14 juillet 1789 et les 12 mois
id 555-7713-22-1 and code 77-1234 are not numbers to call
from 1990-2000 and 2001-2010 the total was 5550123
the sum 0007687199101951 is not a card and 2390409500648960 neither
"""


def labelled(spark: SparkSession) -> DataFrame:
    """The built-in labelled table: text with spans marked as [kind:span]."""
    return spark.createDataFrame([(line,) for line in LABELLED.strip().splitlines()], "text string")


def _tagged(line: str) -> tuple[list[str], list[str]]:
    """Words and labels of one marked line."""
    words, labels = [], []
    mark = re.compile(rf"\[({'|'.join(KINDS)}):((?:[^\[\]]|\[\w+\])*)\]")
    at = 0
    for m in [*mark.finditer(line), None]:
        plain = line[at : m.start() if m else len(line)].split()
        words, labels = words + plain, labels + ["O"] * len(plain)
        if m:
            span = m[2].split()
            words, labels = words + span, labels + [f"B-{m[1]}"] + [f"I-{m[1]}"] * (len(span) - 1)
            at = m.end()
    return words, labels


def train(rows: DataFrame, text: str = "text") -> Crf:
    """The field trained from a labelled table; the first ``TRAINED`` rows by text at most."""
    chosen = rows.select(named(text).alias("text")).filter("text IS NOT NULL").orderBy("text").limit(TRAINED)
    return Crf().train(_tagged(r.text) for r in chosen.collect())


def base_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """The spans of the fixed patterns, leftmost and apart within a kind."""
    after = at = text.find("@")
    last = 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            yield "email", start, m.end()
            last = m.end()
        after = max(at + 1, last)
        at = text.find("@", after)
    if not DIGIT.search(text):
        return
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield "ip", m.start(), m.end()
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()
    for m in PHONE.finditer(text) if "+" in text else ():
        if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            yield "phone", m.start(), m.end()


def _reading(kind: str, span: str) -> tuple[int, int] | None:
    """Where in a marked span its kind stands, if it does."""
    m = READS[kind].search(span)
    if not m:
        return None
    digits = "".join(c for c in m[0] if "0" <= c <= "9")
    least, most = DIGITS.get(kind, (0, len(digits)))
    if not least <= len(digits) <= most or (kind == "card" and not luhn(digits)):
        return None
    return m.start(), m.end()


def _added(text: str, labels: list[int], base: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """The field's spans that read as their kind and touch no base span."""
    places = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    k = 0
    while k < len(labels):
        if not labels[k]:
            k += 1
            continue
        kind, end = LABELS[labels[k]][2:], k + 1
        while end < len(labels) and LABELS[labels[end]] == f"I-{kind}":
            end += 1
        start = places[k][0]
        found = _reading(kind, text[start : places[end - 1][1]])
        if found and all(start + found[1] <= a or start + found[0] >= b for _, a, b in base):
            yield kind, start + found[0], start + found[1]
        k = end


def find(df: DataFrame, model: Crf, text: str = "text") -> DataFrame:
    """``df`` with ``spans``: kind, start, end, and whether the span is a base one."""

    def start():
        decoder = Decoder(model)

        def run(texts):
            words = [(t or "").split() for t in texts]
            classes = [np.array([Decoder.PAD])]
            for ws in words:
                classes += [decoder.number(ws), classes[0]]
            marked = decoder.labels(np.concatenate(classes))
            out, at = [], 1
            for t, ws in zip(texts, words, strict=True):
                base = list(base_spans(t or ""))
                own = marked[at : at + len(ws)]
                more = list(_added(t, own.tolist(), base)) if own.any() else []
                at += len(ws) + 1
                rows = [(*s, True) for s in base] + [(*s, False) for s in more]
                rows.sort(key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
                out.append([dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in rows])
            return (out,)

        return run

    return annotate(df, text, T.StructType().add("spans", T.ArrayType(SPAN)), start)


def redact(df: DataFrame, model: Crf, text: str = "text") -> DataFrame:
    """The rows of ``df`` with every span of the text replaced by its kind in angle brackets.

    Of spans that overlap, the first (then the longer) is replaced, with all the others reach.
    """
    rows, names = plain(df)
    found = find(rows, model, names[text])
    by_start = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    state = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))
    given = F.col(names[text])

    def step(s, x):
        inside = x["start"] < s["at"]
        gap = F.when(inside, F.lit("")).otherwise(F.concat(F.call_function("substring", given, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit("<"), x["kind"], F.lit(">")))
        return F.struct(F.concat(s["done"], gap).alias("done"), F.greatest(s["at"], -x["back"]).alias("at"))

    cut = F.aggregate(by_start, state, step, lambda s: F.concat(s["done"], F.call_function("substring", given, (s["at"] + 1).cast("int"), F.length(given))))
    clean = F.when(given.isNull() | (F.size("spans") == 0), given).otherwise(cut)
    return restored(found.withColumn(names[text], clean), names)
