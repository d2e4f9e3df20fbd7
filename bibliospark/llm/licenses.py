"""License scans by template-markup matching.

A template is words with marked regions: ``<<optional>> ... <<end>>`` may be left out, ``<<var min max>>`` stands for
that many words of any kind. It is compiled into a token automaton whose states are positions in the template;
a text is accepted where the automaton runs from the template's first mandatory words to its end, so mandatory wording
must match exactly. Automata run only at places where their anchor, the longest mandatory run of words, occurs.

Defined cases: null text is empty; empty texts have no words, no labels and score 0; repeated rows are scanned each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bytes_of, small_batches

#: Phrases whose words in a row give a label (fixed values).
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Templates by label, in the markup above; public license texts and notices (fixed values).
TEMPLATES = {
    "gpl-notice": "<<optional>> this work is <<end>> licensed under the gnu general public license <<optional>> version <<var 1 2>> <<end>>",
    "gpl-or-later": "under the terms of the gnu general public license as published by the free software foundation either version <<var 1 2>> of the license or <<optional>> at your option <<end>> any later version",
    "gpl-header": """<<optional>> this program is free software you can redistribute it and or modify it <<end>> under the terms of the gnu general public license as published by
        the free software foundation either version <<var 1 2>> of the license or <<optional>> at your option <<end>> any later version this program is distributed in the hope that it will be useful
        but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details""",
    "lgpl-header": """under the terms of the gnu lesser general public license as published by the free software foundation either version <<var 1 2>> of the license or
        <<optional>> at your option <<end>> any later version""",
    "mpl-2.0-header": """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at
        <<optional>> <<var 1 1>> <<end>> mozilla org mpl 2 0""",
    "apache-2.0-notice": "licensed under the apache license version 2 <<optional>> 0 <<end>> <<optional>> the license <<end>>",
    "apache-2.0-header": """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at
        <<optional>> <<var 1 9>> <<end>> unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or
        conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license""",
    "cc-by-nc-notice": "licensed under cc by nc <<optional>> <<var 1 1>> 0 <<end>>",
    "mit-notice": "<<optional>> released <<end>> under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files <<optional>> the software <<end>> to deal in <<var 1 2>> software without restriction",
    "mit-text": """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files <<optional>> the software <<end>> to deal in
        <<var 1 2>> software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit
        persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice
        <<optional>> including the next paragraph <<end>> shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind
        express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall <<var 1 9>> be liable for any
        claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software""",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-2-text": """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<optional>> 1 <<end>>
        redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<optional>> 2 <<end>> redistributions in binary form must
        reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is
        provided by <<var 1 9>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed""",
    "bsd-3-text": """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<optional>> 1 <<end>>
        redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<optional>> 2 <<end>> redistributions in binary form must
        reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution <<optional>> 3 <<end>>
        neither the name of <<var 1 12>> may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by
        <<var 1 9>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed""",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-text": """permission to use copy modify <<optional>> and or <<end>> <<optional>> and <<end>> distribute this software for any purpose with or without fee is hereby granted provided that the above
        copyright notice and this permission notice appear in all copies the software is provided as is and <<var 1 4>> disclaims all warranties with regard to this software including all implied
        warranties of merchantability and fitness in no event shall <<var 1 4>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of
        use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software""",
}
#: Every byte that is no word character, as a blank; A-Z lower-cased first.
_WORDS = bytes(b if chr(b).isdigit() or 97 <= b <= 122 or b >= 128 else 32 for b in range(128)) + bytes(range(128, 256))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_TABLE = bytes(_WORDS[_LOWER[b]] for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Automaton:
    """States are positions in the compiled steps: (word or None for any, whether the step may be left out)."""

    def __init__(self, template: str):
        steps: list[tuple[bytes | None, int]] = []  # (word, where a skip from here leads; itself if none)
        stack: list[int] = []
        runs: list[list[bytes]] = [[]]
        skips: dict[int, set[int]] = {}
        for mark, lo, hi, word in re.findall(r"<<(optional|end|var)(?: (\d+) (\d+))?>>|(\S+)", template):
            if mark == "optional":
                stack.append(len(steps))
            elif mark == "end":
                skips.setdefault(stack.pop(), set()).add(len(steps))
            elif mark == "var":
                for n in range(int(hi)):
                    if n >= int(lo):
                        skips.setdefault(len(steps), set()).add(len(steps) + int(hi) - n)
                    steps.append((None, 0))
            else:
                steps.append((word.encode(), 0))
            if word and not stack:
                runs[-1].append(word.encode())
            else:
                runs.append([])
        if stack:
            raise ValueError("an optional region has no end")
        self.words = [s[0] for s in steps]
        self.skips = skips
        self.anchor = b" " + b" ".join(max(runs, key=len)) + b" "
        self.final = len(steps)
        first = self.anchor.split()
        at = next(i for i in range(len(steps)) if self.words[i : i + len(first)] == first)
        self.before = at  # steps before the anchor: how far back a match may begin

    def closed(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for s in self.skips.get(todo.pop(), ()):
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return out

    def longest(self, words: list[bytes], begin: int) -> int:
        """The end of the longest match that begins here, or -1."""
        states, end, at = self.closed({0}), -1, begin
        while True:
            if self.final in states:
                end = at
            if at >= len(words) or not states:
                return end
            word = words[at]
            states = self.closed({s + 1 for s in states if s < self.final and (self.words[s] is None or self.words[s] == word)})
            at += 1


def scanner(base: dict[str, str], templates: dict[str, str]):
    """A function from text to (n_words, starts of base phrases, base labels, labels, words that templates cover)."""
    phrases = [(b" " + p.encode() + b" ", label) for p, label in base.items()]
    automata = [(label, Automaton(t)) for label, t in templates.items()]

    def places(joined: bytes, needle: bytes) -> list[int]:
        out, at, counted, number = [], joined.find(needle), 0, 0
        while at >= 0:
            number += joined.count(b" ", counted, at)
            out.append(number)
            counted, at = at, joined.find(needle, at + 1)
        return out

    def scan(text: bytes):
        words = words_of(text)
        joined = b" " + b" ".join(words) + b" "
        starts, own, labels, covered = [], set(), set(), set()
        for needle, label in phrases:
            if found := places(joined, needle):
                starts += found
                own.add(label)
        for label, automaton in automata:
            for at in places(joined, automaton.anchor):
                for begin in range(max(0, at - automaton.before), at + 1):
                    end = automaton.longest(words, begin)
                    if end > at:
                        labels.add(label)
                        covered.update(range(begin, end))
                        break
        return len(words), starts, own, labels | own, covered

    return scan


def scan_licenses(docs: DataFrame, base: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, n_covered, score) of every document.

    score: 1 where a template accepts, else 0.5 where a base phrase stands, else 0.
    """
    small_batches(docs.sparkSession)
    base, templates = BASE if base is None else base, TEMPLATES if templates is None else templates
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, n_covered long, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(base, templates)
        for batch in batches:
            rows = []
            for text in bytes_of(batch.column("text")):
                n, starts, own, labels, covered = scan(text)
                score = 1.0 if labels - own else 0.5 if own else 0.0
                rows.append((n, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(labels)), len(covered), score))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64(), pa.float64()]
            columns = zip(*rows) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=[f.split()[0] for f in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
