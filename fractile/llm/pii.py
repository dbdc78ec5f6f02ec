"""Personal data: patterns plus a linear-chain conditional random field.

The field labels words with O or the beginning or inside of a name, an address
or an identifier. Its features are the words of the training table and the
shapes of all words, of the word itself and of both neighbours, whether a word
repeats the one before, and label transitions. It is trained by gradient ascent
on a small labelled table of sentences. Texts are cut at sentence ends; sentences
of a batch are decoded together, one Viterbi step a word position, in numpy. A
constant against every label but O keeps plain prose unmarked.

Defined cases: a null or empty text has no finding; a repeated row is scanned
again, null ids stay null; very long words, sentences and runs are taken whole;
other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from fractile.llm.spans import Span, scan_documents

BASE_KINDS = ("email", "ip", "card", "phone")
OWN_KINDS = ("name", "address", "identifier")
#: Words decoded at once.
BATCH_WORDS = 400_000
#: Against every label but O, for any word and for words of a shape that training hasn't seen.
CAUTION = 2.0
STRANGE = 6.0

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


#: Words with a full stop that don't end a sentence, as initials don't either.
ABBREVIATIONS = {"mr.", "mrs.", "ms.", "dr.", "prof.", "st.", "no.", "nr.", "sr.", "sra.", "mme.", "hr.", "fr.", "jr.", "str.", "apt."}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    last = 0
    if "@" in text:
        for m in _AT.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                found.append((start, m.end(), "email"))
                last = m.end()
    found += [(*m.span(), "ip") for m in _IP.finditer(text) if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for g in m.groups())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append((*m.span(), "card"))
    if "+" in text:
        found += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


LABELS = ["O"] + [f"{p}-{k}" for k in OWN_KINDS for p in "BI"]
#: The labelled table. {n:...} is a name, {a:...} an address, {i:...} an identifier.
TABLE = """
My name is {n:John Smith} and I work in sales.
Please contact {n:Maria Garcia} about the invoice.
Dear Mr. {n:Peter Jones}, thank you for the letter.
Dear Mrs. {n:Helen Baker}, your order has shipped.
Signed by Dr. {n:Alan Wright} on Monday.
The patient {n:Laura Chen} was admitted yesterday.
Name: {n:Robert Brown}
Full name: {n:Susan Lee Miller}
Customer: {n:David Wilson}
Ms. {n:Karen White} will call you.
She was born as {n:Anna Novak} in the north.
I am {n:James Taylor} from support.
Regards, {n:Emily Clark}
The contract names {n:Thomas Moore} as owner.
Contact: {n:Julia Roberts}
He lives at {a:12 Oak Street} with a dog.
She lives at {a:221 Baker Street} since May.
Address: {a:45 Elm Avenue}
Our office is at {a:900 Market Street} near the bank.
Ship it to {a:7 Hill Road} today.
Send the parcel to {a:1600 Green Lane} please.
Address: {a:18 Park Boulevard}
We moved to {a:33 River Drive} last year.
Home address: {a:5 Church Lane}
Social security number {i:123-45-6789} is on file.
SSN: {i:987-65-4321}
His SSN is {i:078-05-1120} and is private.
Passport number {i:X1234567} expires soon.
Passport: {i:K8892310}
Driver license {i:D123-4567} was checked.
IBAN: {i:DE89370400440532013000}
The IBAN {i:GB29NWBK60161331926819} is hers.
Tax id {i:12-3456789} belongs to them.
National id {i:AB123456C} was shown.
Account number {i:00123456789} is closed.
The Street was empty and the Road was long.
The name of the game is patience.
The address of the page has changed.
Dear all, the meeting moved to Tuesday.
Dear customer, thank you for the order.
Contact us at any time.
He is at home and she is at work.
It was 12 degrees at noon.
Chapter 12 is about the River Thames.
Version 2.0 was released in 2014 and 2015.
The order 4411 has 12 lines.
Call me at noon on 12 May.
In and on the of that this is.
The and to of a in is it.
And then the. Of it, that was.
The Market opened at nine. Trade was slow.
Die der und das ist ein nicht.
El la de que y en los se.
Le la de et les des un une.
Und der die das. Nicht auch.
Elle un la. Que de les.
Para los de un. Con la que.
Address the issue in the next release.
Name the main cause of this.
Number of rows is 12000 here.
The passport office is closed.
Released under the MIT License.
Licensed under the Apache License, Version 2.0.
See the GNU General Public License for details.
This work is licensed under CC BY 4.0.
Version 3.1 is older than Version 3.2 of it.
My account is new and the number is long.
Mein Name ist {n:Hans Schmidt} und ich komme aus Bonn.
Sehr geehrte Frau {n:Petra Wagner}, vielen Dank.
Sehr geehrter Herr {n:Karl Fischer}, die Rechnung ist da.
Ansprechpartner: {n:Julia Becker}
Er wohnt in der {a:Hauptstraße 12} seit Mai.
Anschrift: {a:Gartenweg 7}
Adresse: {a:Lindenallee 33}
Steuernummer {i:12/345/67890} liegt vor.
Ausweisnummer: {i:L01X00T47}
Je m'appelle {n:Marie Dubois} et je travaille ici.
Madame {n:Claire Martin} est absente.
Monsieur {n:Paul Bernard} viendra demain.
Elle habite au {a:14 rue Victor} depuis mai.
Adresse : {a:8 avenue Foch}
Me llamo {n:Carlos Romero} y vivo lejos.
La señora {n:Elena Torres} no vino.
Nombre: {n:Pablo Ruiz}
Vive en la {a:Calle Mayor 15} con su madre.
Domicilio: {a:Avenida Sol 22}
DNI: {i:12345678Z}
NIF {i:87654321X} del cliente.
The manager, {n:Olivia Grant}, signed it.
Sincerely, {n:Frank Hill}
Patient: {n:Mary Ann Lewis}
Send it to {a:9 North Main Street Apartment 3 Boston 02110} now.
Tea.
Yes.
No.
In.
And.
Onou Onou Onou Onou Onou.
Enie Enie Enie Enie Enie Enie
Hare Hare Hare Hare or or or or.
Tal Tal Tal the the the.
In In In In In In on on on.
Ment Ment Ment Ment le le.
Lest lest. Lest Lest Lest and and.
Der Der Der Der Der Der und und.
Anto Anto Anto Anto Anto Anto Anto Anto
Wo die Straße endet, ist es still.
La calle era larga y el nombre corto.
La rue est belle, le nom aussi.
Call +1 (212) 555-0187 Monday or later.
+1 (415) 555-0134 Answers are given at noon.
Phone: +1 (646) 555-0172 Extension is two.
Die Adresse der Seite ist neu.
"""


def shape(word: str) -> str:
    """Letters and digits as X, x and d, runs of over two shortened, other characters kept."""
    out: list[str] = []
    for c in word:
        s = "d" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c
        if len(out) < 2 or out[-1] != s or out[-2] != s:
            out.append(s)
    return "".join(out)


def _sentences() -> list[tuple[list[str], list[int]]]:
    out = []
    for line in TABLE.strip().splitlines():
        words, labels = [], []
        for m in re.finditer(r"\{(\w):([^}]*)\}(\S*)|(\S+)", line):
            if m[1]:
                kind = next(k for k in OWN_KINDS if k[0] == m[1])
                own = (m[2] + m[3]).split()
                labels += [LABELS.index(("I-" if k else "B-") + kind) for k in range(len(own))]
            else:
                own = [m[4]]
                labels.append(0)
            words += own
        out.append((words, labels))
    return out


#: The feature of a word that repeats the one before it in its sentence.
AGAIN = "again"


@dataclass
class Field:
    """weights[o, f, l]: feature f of the word at offset o - 1 votes for label l. Feature 0 is an unknown one."""

    features: dict[str, int]
    weights: np.ndarray
    moves: np.ndarray
    first: np.ndarray

    def votes(self, words: list[str]) -> np.ndarray:
        """(3, words, labels): what each word says of the word after it, of itself, and of the word before it."""
        get = self.features.get
        own = np.fromiter((get("w:" + w.lower(), 0) for w in words), np.int64, len(words))
        shapes = np.fromiter((get("s:" + shape(w), 0) for w in words), np.int64, len(words))
        votes = self.weights[:, own] + self.weights[:, shapes]
        votes[1, shapes == 0, 1:] -= STRANGE
        return votes


def _known(words: list[str], labels: list[int]) -> list[tuple[str, ...]]:
    """Features in training: the words of a name or identifier count by shape alone, the last word of an address as itself."""
    out = []
    for k, (w, y) in enumerate(zip(words, labels)):
        kind = LABELS[y][2:]
        open_class = kind in ("name", "identifier") or (kind == "address" and not (k + 1 == len(words) or labels[k + 1] != y))
        again = (AGAIN,) if k and w == words[k - 1] else ()
        out.append((("s:" + shape(w),) if open_class else ("w:" + w.lower(), "s:" + shape(w))) + again)
    return out


def train(rounds: int = 300, rate: float = 0.1, ridge: float = 0.02) -> Field:
    """Maximum likelihood with a ridge, by Adam on forward-backward gradients over the whole table, all sentences at once."""
    data = _sentences()
    known = [_known(w, y) for w, y in data]
    names = sorted({f for s in known for fs in s for f in fs})
    index = {f: k + 1 for k, f in enumerate(names)}
    n_labels, lengths = len(LABELS), np.array([len(w) for w, _ in data])
    size, longest = len(data), int(lengths.max())
    held = np.arange(longest) < lengths[:, None]
    # One row an occurrence of a feature: its sentence, its place, itself.
    at = np.array([(s, t, index[f]) for s, own in enumerate(known) for t, fs in enumerate(own) for f in fs])
    votes_for = [at[(0 <= at[:, 1] + 1 - o) & (at[:, 1] + 1 - o < lengths[at[:, 0]])] for o in range(3)]
    truth = np.zeros((size, longest, n_labels))
    moved = np.zeros((n_labels, n_labels))
    for s, (_, labels) in enumerate(data):
        truth[s, np.arange(len(labels)), labels] = 1
        np.add.at(moved, (labels[:-1], labels[1:]), 1)
    params = [np.zeros((3, len(index) + 1, n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, rounds + 1):
        weights, moves, first = params
        e = np.zeros((size, longest, n_labels))
        for o, rows in enumerate(votes_for):
            np.add.at(e, (rows[:, 0], rows[:, 1] + 1 - o), weights[o, rows[:, 2]])
        a, b = np.zeros_like(e), np.zeros_like(e)
        a[:, 0] = e[:, 0] + first
        for t in range(1, longest):
            a[:, t] = e[:, t] + np.logaddexp.reduce(a[:, t - 1, :, None] + moves, axis=1)
        for t in range(longest - 2, -1, -1):
            b[:, t] = np.where(held[:, t + 1, None], np.logaddexp.reduce(moves + (e[:, t + 1] + b[:, t + 1])[:, None, :], axis=2), 0.0)
        z = np.logaddexp.reduce(a[np.arange(size), lengths - 1], axis=1)
        gap = np.where(held[:, :, None], truth - np.exp(a + b - z[:, None, None]), 0.0)
        grads = [-ridge * p for p in params]
        for o, rows in enumerate(votes_for):
            np.add.at(grads[0][o], rows[:, 2], gap[rows[:, 0], rows[:, 1] + 1 - o])
        pairs = np.exp(a[:, :-1, :, None] + moves + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None])
        grads[1] += moved - np.where(held[:, 1:, None, None], pairs, 0.0).sum(axis=(0, 1))
        grads[2] += gap[:, 0].sum(axis=0)
        for k, g in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            params[k] = params[k] + rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    params[0][:, 0] = 0
    for k in range(2, n_labels, 2):  # an inside label follows its own kind alone
        forbidden = [j for j in range(n_labels) if j not in (k - 1, k)]
        params[1][forbidden, k] = -1e4
        params[2][k] = -1e4
    return Field(index, *params)


def viterbi(emit: np.ndarray, starts: np.ndarray, lengths: np.ndarray, moves: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Best labels of sentences that lie one after the other in emit, decoded together, longest first."""
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    n_labels = emit.shape[1]
    labels = np.zeros(len(emit), np.int8)
    back = np.zeros((len(emit), n_labels), np.int8)
    score = emit[starts] + first
    final = np.zeros((len(starts), n_labels))
    active = len(starts)
    for t in range(1, int(lengths[0])):
        still = int(np.searchsorted(-lengths, -t, side="left"))
        final[still:active] = score[still:active]
        active = still
        paths = score[:active, :, None] + moves
        best = paths.argmax(axis=1)
        rows = starts[:active] + t
        back[rows] = best
        score = np.take_along_axis(paths, best[:, None, :], axis=1)[:, 0] + emit[rows]
    final[:active] = score[:active]
    state = final.argmax(axis=1)
    labels[starts + lengths - 1] = state
    for t in range(int(lengths[0]) - 1, 0, -1):
        active = int(np.searchsorted(-lengths, -t, side="left"))
        rows = starts[:active] + t
        state[:active] = back[rows, state[:active]]
        labels[rows - 1] = state[:active]
    return labels


_WORD = re.compile(r"\S+")


def label_texts(field: Field, texts: list[str]) -> list[list[Span]]:
    out: list[list[Span]] = [[] for _ in texts]
    begin = 0
    while begin < len(texts):
        end, words, counts = begin, [], []
        while end < len(texts) and (end == begin or len(words) < BATCH_WORDS):
            own = texts[end].split()
            words += own
            counts.append(len(own))
            end += 1
        if words:
            labels = _decode(field, words, np.array(counts))
            last = 0
            for k, n in enumerate(counts):
                if labels[last : last + n].any():
                    out[begin + k] = _spans(texts[begin + k], labels[last : last + n])
                last += n
        begin = end
    return out


def _decode(field: Field, words: list[str], counts: np.ndarray) -> np.ndarray:
    codes, distinct = pd.factorize(np.array(words, dtype=object))
    votes = field.votes(list(distinct)).astype(np.float32)
    closes = np.fromiter((w[-1] in ".!?" and w.lower() not in ABBREVIATIONS and not (len(w) == 2 and w[0].isupper()) for w in distinct), bool, len(distinct))[codes]
    stops = np.cumsum(counts)
    closes[stops[counts > 0] - 1] = True
    ends = np.flatnonzero(closes) + 1
    starts = np.concatenate([[0], ends[:-1]])
    emit = votes[1][codes]
    inner = np.ones(len(codes), bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    emit[at] += votes[0][codes[at - 1]]
    emit[at - 1] += votes[2][codes[at]]
    again = at[codes[at] == codes[at - 1]]
    told = field.weights[:, field.features.get(AGAIN, 0)].astype(np.float32)
    emit[again] += told[1]
    emit[again - 1] += told[2]
    after = again[again + 1 < len(codes)] + 1
    emit[after[inner[after]]] += told[0]
    emit[:, 1::2] -= CAUTION
    return viterbi(emit, starts, ends - starts, field.moves.astype(np.float32), field.first.astype(np.float32))


def _spans(text: str, labels: np.ndarray) -> list[Span]:
    places = [m.span() for m in _WORD.finditer(text)]
    found, k = [], 0
    while k < len(labels):
        if labels[k] % 2 == 1:
            end = k + 1
            while end < len(labels) and labels[end] == labels[k] + 1:
                end += 1
            a, b = places[k][0], places[end - 1][1]
            while b > a and text[b - 1] in ".,;:!?)":
                b -= 1
            found.append((a, b, LABELS[labels[k]][2:]))
            k = end
        else:
            k += 1
    return found


def scan_personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_name, n_address, n_identifier, n_spans."""
    field = field or train()
    return scan_documents(docs, base_spans, lambda texts: label_texts(field, texts), BASE_KINDS, OWN_KINDS)


def query(spark, sf_dir: str) -> DataFrame:
    from fractile.llm.common import table

    return scan_personal_data(table(spark, sf_dir, "documents"))
