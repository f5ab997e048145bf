"""License scan by an exact containment join between text blocks and templates.

A block is a line of a text, or a paragraph: lines up to one without words, so
that a wrapped notice is one block. A template's tokens are ordered by how many blocks
of the whole corpus have them, rarest first. To contain a share t of a
template of n tokens, a block must have one of its n - ceil(t n) + 1 rarest
(prefix filter), have ceil(t n) distinct tokens at all (length filter), and at
its first common token both sides must have enough tokens left (positional
filter); what passes is counted exactly. Nothing is sampled, so every block
that reaches the threshold is found and counted. A notice is a template with
phrases that tell its license from others (name, version, nc). Its label is
given where the block has them word for word and reaches the threshold in the
words near the first of them, as many on either side as the template has, so
that a long paragraph is no license because its words lie about in it. A block
that contains a notice without that is reported as unconfirmed.

The templates are few and given; they go to every task, and a set beyond a
stated number of tokens is refused. Null text is empty. Templates without
tokens match nothing. Repeated rows are judged each. An empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotary.llm.common import record_batch, slices, take
from quotary.llm.words import MARKS, Words, scan

#: Phrases that name a license, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Notices by which works are put under a license, and the labels of the method.
TEMPLATES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0"],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0"],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3",
                "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                "the Free Software Foundation, either version 3 of the License"],
    "mit": ["Released under the MIT License",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"],
}


@dataclass(frozen=True)
class Notice:
    """A template, and the phrases without which a block is about another license."""

    text: str
    keys: tuple[str, ...]


def _notices() -> dict[str, list[Notice]]:
    """Notices of common licenses and paragraphs of their bodies, by SPDX-like label.

    Short notices are built for every license from its names; then come the
    headers that the licenses themselves recommend and what opens their texts.
    """
    names = {
        "agpl-3.0": ["GNU Affero General Public License, version 3", "AGPL-3.0", "AGPLv3"],
        "apache-2.0": ["Apache License, Version 2.0", "Apache 2.0 License", "Apache-2.0"],
        "artistic-2.0": ["Artistic License 2.0", "Artistic-2.0"],
        "bsd-2-clause": ["BSD 2-Clause License", "2-Clause BSD License", "BSD-2-Clause", "Simplified BSD License"],
        "bsd-3-clause": ["BSD 3-Clause License", "3-Clause BSD License", "BSD-3-Clause", "New BSD License"],
        "bsl-1.0": ["Boost Software License, Version 1.0", "BSL-1.0"],
        "cc0-1.0": ["CC0 1.0", "Creative Commons Zero 1.0"],
        "epl-2.0": ["Eclipse Public License 2.0", "Eclipse Public License, version 2.0", "Eclipse Public License v 2.0", "EPL-2.0"],
        "gpl-2.0": ["GNU General Public License, version 2", "GNU GPL version 2", "GPL-2.0", "GPLv2"],
        "gpl-3.0": ["GNU General Public License, version 3", "GNU GPL version 3", "GPL-3.0", "GPLv3"],
        "isc": ["ISC License"],
        "lgpl-2.1": ["GNU Lesser General Public License, version 2.1", "LGPL-2.1", "LGPLv2.1"],
        "lgpl-3.0": ["GNU Lesser General Public License, version 3", "LGPL-3.0", "LGPLv3"],
        "mit": ["MIT License"],
        "mpl-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0", "MPL 2.0"],
        "unlicense": ["Unlicense"],
        "zlib": ["zlib License"],
    }
    long = {"by": "Attribution", "nc": "NonCommercial", "nd": "NoDerivatives", "sa": "ShareAlike"}
    for kind in ("by", "by-nc", "by-nd", "by-sa", "by-nc-nd", "by-nc-sa"):
        for version in ("2.0", "2.5", "3.0", "4.0"):
            names[f"cc-{kind}-{version}"] = [f"CC {kind.upper()} {version}",
                                             f"Creative Commons {'-'.join(long[k] for k in kind.split('-'))} {version}"]
    out = {label: [Notice(form.format(name), (name,)) for name in own
                   for form in ("Licensed under {}", "Licensed under the {}", "Released under the {}", "This work is licensed under the {}",
                                "Distributed under the terms of the {}")] for label, own in names.items()}
    for label in names:
        spdx = f"SPDX-License-Identifier: {label}"
        out[label].append(Notice(spdx, (spdx,)))
    # what names a license at the head of its text
    for label, heading in {
        "agpl-3.0": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "apache-2.0": "Apache License Version 2.0, January 2004",
        "bsl-1.0": "Boost Software License - Version 1.0 - August 17th, 2003", "gpl-2.0": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "gpl-3.0": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "lgpl-2.1": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
        "lgpl-3.0": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "epl-2.0": "Eclipse Public License - v 2.0",
        "mpl-2.0": "Mozilla Public License Version 2.0", "cc0-1.0": "Creative Commons CC0 1.0 Universal",
    }.items():
        out[label].append(Notice(heading, (heading,)))
    gnu = ("{} is free software{} you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software "
           "Foundation, either version {} of the License, or (at your option) any later version")
    for label, name, version in (("agpl-3.0", "Affero General Public License", "3"), ("gpl-2.0", "General Public License", "2"),
                                 ("gpl-3.0", "General Public License", "3"), ("lgpl-2.1", "Lesser General Public License", "2.1"),
                                 ("lgpl-3.0", "Lesser General Public License", "3")):
        out[label].append(Notice(gnu.format("This program", ":", name, version), (f"GNU {name} as published", f"version {version} of the License")))
        out[label].append(Notice(f"You can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software "
                                 f"Foundation, version {version} of the License", (f"GNU {name} as published", f"version {version} of the License")))
        out[label].append(Notice(f"You can redistribute it and/or modify it under the terms of the GNU {name} version {version} as published by "
                                 "the Free Software Foundation", (f"GNU {name} version {version}",)))
    more = {
        "apache-2.0": [("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
                        "License. You may obtain a copy of the License at", ("Apache License Version 2.0",))],
        "mit": [("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
                 "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
                 "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
                 "Software is furnished to do so, subject to the following conditions",
                 ("Permission is hereby granted free of charge to any person obtaining a copy of this software", "without restriction")),
                ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
                 ("Permission is hereby granted free of charge to any person obtaining a copy of this software and associated",))],
        "bsl-1.0": [("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
                     "accompanying documentation covered by this license", ("any person or organization obtaining a copy",))],
        "isc": [("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
                 "provided that the above copyright notice and this permission notice appear in all copies",
                 ("for any purpose with or without fee is hereby granted", "this permission notice appear in all copies"))],
        # the grant is common to the BSD licenses; the clause on endorsement tells the third one
        "bsd": [("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
                 "conditions are met", ("Redistribution and use in source and binary forms",))],
        "bsd-3-clause": [("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
                          "products derived from this software without specific prior written permission",
                          ("endorse or promote products derived from this software without specific prior written permission",))],
        "mpl-2.0": [("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                     "distributed with this file, You can obtain one at", ("Mozilla Public License v 2.0",))],
        "epl-2.0": [("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
                     ("Eclipse Public License 2.0",))],
        "unlicense": [("This is free and unencumbered software released into the public domain",
                       ("free and unencumbered software released into the public domain",))],
        "zlib": [("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
                  "for any damages arising from the use of this software", ("in no event will the authors be held liable",))],
    }
    for label, own in more.items():
        out.setdefault(label, []).extend(Notice(*n) for n in own)
    return out


#: The registered scan's templates.
NOTICES = _notices()
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
                  ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
                  ("n_blocks", pa.int64()), ("unconfirmed", pa.string())])
_OUT_DDL = ("doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
            "labels string, score double, n_blocks bigint, unconfirmed string")


@dataclass
class Order:
    """The template tokens, the place of each in the corpus order (rarest first), and the templates in those places."""

    vocabulary: np.ndarray
    rank: np.ndarray
    templates: list[tuple[str, np.ndarray, int]]  # label, ascending ranks, how many a block needs
    keys: list[list[np.ndarray]]  # of each template, hashes of the phrases that a block must have
    reach: list[int]  # of each template, its words


def _tokens(texts: list[str]) -> list[np.ndarray]:
    words = scan([t.encode() for t in texts], MARKS, lower=True)
    return [words.hashes[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]


def _line_of(words: Words) -> np.ndarray:
    """A number for the line of each word; lines of different texts differ."""
    return np.searchsorted(np.flatnonzero(words.buf == 0x0A), words.starts)


def _paragraph_of(words: Words) -> np.ndarray:
    """A number for the paragraph of each word: lines of one text up to a line without words."""
    if not words.starts.size:
        return np.zeros(0, np.int64)
    cut = (np.diff(_line_of(words)) > 1) | (np.diff(words.texts) != 0)
    return np.concatenate([[0], np.cumsum(cut)])


def _places(hashes: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Where ``phrase`` starts in a run of words."""
    at = np.flatnonzero(hashes[: max(hashes.size - phrase.size + 1, 0)] == phrase[0])
    for k, token in enumerate(phrase[1:], 1):
        at = at[hashes[at + k] == token]
    return at


def _find(vocabulary: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Place of each word in the sorted vocabulary, -1 for others."""
    if not vocabulary.size:
        return np.full(hashes.size, -1)
    at = np.minimum(np.searchsorted(vocabulary, hashes), vocabulary.size - 1)
    return np.where(vocabulary[at] == hashes, at, -1)


def block_frequencies(docs: DataFrame, vocabulary: np.ndarray, block_of=_line_of) -> np.ndarray:
    """In how many blocks of the corpus each template token stands."""
    schema = pa.schema([("token", pa.int32()), ("n", pa.int64())])

    def rows(batches):
        total = np.zeros(vocabulary.size, np.int64)
        for batch in slices(batches):
            words = scan(batch.column("text"), MARKS, lower=True)
            at = _find(vocabulary, words.hashes)
            own = at >= 0
            pair = np.unique(block_of(words)[own] * vocabulary.size + at[own])
            total += np.bincount(pair % max(vocabulary.size, 1), minlength=vocabulary.size)
        some = np.flatnonzero(total)
        yield record_batch(schema, [some.astype(np.int32), total[some]])

    counted = docs.select("text").mapInArrow(rows, "token int, n bigint").groupBy("token").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(vocabulary.size, np.int64)
    for r in counted:
        out[r["token"]] = r["n"]
    return out


def corpus_order(docs: DataFrame, templates: dict[str, list[str | Notice]], containment: float, most_tokens: int,
                 block_of=_line_of) -> Order:
    given = [(label, t if isinstance(t, Notice) else Notice(t, ())) for label, own in templates.items() for t in own]
    given = [(label, t, tokens) for (label, t), tokens in zip(given, _tokens([t.text for _, t in given]), strict=True) if tokens.size]
    sets = [(label, np.unique(tokens)) for label, _, tokens in given]
    if sum(t.size for _, t in sets) > most_tokens:
        raise ValueError(f"templates of more than {most_tokens} tokens; scan for them in several calls")
    vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *[t for _, t in sets]]))
    rank = np.empty(vocabulary.size, np.int64)
    rank[np.lexsort((vocabulary, block_frequencies(docs, vocabulary, block_of)))] = np.arange(vocabulary.size)
    return Order(vocabulary, rank, [(label, np.sort(rank[_find(vocabulary, t)]), math.ceil(containment * t.size - 1e-9))
                                    for label, t in sets],
                 [_tokens(list(t.keys)) for _, t, _ in given], [tokens.size for _, _, tokens in given])


def _near_key(hashes: np.ndarray, ranks: np.ndarray, tokens: np.ndarray, keys: list[np.ndarray], reach: int) -> int:
    """Most tokens of a template near its first key, in a block that has the other keys there too; 0 without the keys."""
    most = 0
    for p in _places(hashes, keys[0]).tolist():
        a, b = max(p - reach, 0), p + keys[0].size + reach
        if all(_places(hashes[a:b], k).size for k in keys[1:]):
            most = max(most, int(np.isin(tokens, ranks[a:b]).sum()))
    return most


def _contained(words: Words, order_of: Order, block_of=_line_of):
    """(text, block, label, share) of every block that contains enough of a template; no share where its phrases are not there."""
    vocabulary, rank, templates = order_of.vocabulary, order_of.rank, order_of.templates
    at = _find(vocabulary, words.hashes)
    line = block_of(words)
    own = np.flatnonzero(at >= 0)
    # the block's template tokens, in the corpus order
    pair = np.unique(line[own] * vocabulary.size + rank[at[own]])
    block, order = pair // max(vocabulary.size, 1), pair % max(vocabulary.size, 1)
    edges = np.append(np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])), block.size) if block.size else np.zeros(1, int)
    prefixes: dict[int, list[int]] = {}
    for i, (_, tokens, needed) in enumerate(templates):
        for p in tokens[: tokens.size - needed + 1].tolist():
            prefixes.setdefault(p, []).append(i)
    asked = np.isin(order, np.array(list(prefixes), np.int64))
    for b in np.unique(np.searchsorted(edges, np.flatnonzero(asked), side="right") - 1).tolist():
        has = order[edges[b] : edges[b + 1]]
        here = slice(*np.searchsorted(line, [block[edges[b]], block[edges[b]] + 1]))
        size = np.unique(words.hashes[here]).size
        home = int(np.searchsorted(words.first, here.start, side="right")) - 1
        ranks = np.where(at[here] < 0, -1, rank[at[here]])
        for i in sorted({i for p in has.tolist() for i in prefixes.get(p, ())}):
            label, tokens, needed = templates[i]
            if size < needed:
                continue
            common = np.isin(tokens, has)
            first = int(np.flatnonzero(common)[0])
            if min(tokens.size - first, has.size - int(np.searchsorted(has, tokens[first]))) < needed:
                continue
            n = int(common.sum())
            if n < needed:
                continue
            if order_of.keys[i]:
                n = _near_key(words.hashes[here], ranks, tokens, order_of.keys[i], order_of.reach[i])
            yield home, int(block[edges[b]]), label, float(n / tokens.size) if n >= needed else None


def scan_licenses(docs: DataFrame, templates: dict[str, list[str | Notice]] | None = None, phrases: dict[str, str] | None = None,
                  containment: float = 0.8, most_tokens: int = 100_000, id: str = "doc_id", text: str = "text",
                  paragraphs: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the largest
    share of a template that a block contains with its phrases, 0 below the threshold), n_blocks (blocks that contain
    a template) and unconfirmed (labels of templates contained without their phrases). ``paragraphs``: blocks are
    paragraphs, not lines."""
    block_of = _paragraph_of if paragraphs else _line_of
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    docs = take(docs, doc_id=id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = corpus_order(docs, templates, containment, most_tokens, block_of)
    named = [(label, p) for label, p in zip(phrases.values(), _tokens(list(phrases)), strict=True) if p.size]

    def rows(batches):
        for batch in slices(batches):
            words = scan(batch.column("text"), MARKS, lower=True)
            n_texts, n = batch.num_rows, np.diff(words.first)
            left = np.repeat(words.first[1:], n) - np.arange(words.starts.size)
            base: list[set] = [set() for _ in range(n_texts)]
            places = []
            for label, phrase in named:
                at = np.flatnonzero((words.hashes == phrase[0]) & (left >= phrase.size))
                for k, token in enumerate(phrase[1:].tolist(), 1):
                    at = at[words.hashes[at + k] == token]
                places.append(at)
                for t in np.unique(np.searchsorted(words.first, at, side="right") - 1).tolist():
                    base[t].add(label)
            at = np.sort(np.concatenate([np.zeros(0, np.int64), *places]))
            low, high = np.searchsorted(at, words.first[:-1]), np.searchsorted(at, words.first[1:])
            more, score = [set(b) for b in base], [0.0] * n_texts
            blocks: list[set] = [set() for _ in range(n_texts)]
            doubt: list[set] = [set() for _ in range(n_texts)]
            for t, block, label, share in _contained(words, order, block_of):
                blocks[t].add(block)
                (doubt if share is None else more)[t].add(label)
                score[t] = max(score[t], share or 0.0)
            first = [int(at[a] - f) if b > a else None for a, b, f in zip(low, high, words.first[:-1], strict=True)]
            last = [int(at[b - 1] - f) if b > a else None for a, b, f in zip(low, high, words.first[:-1], strict=True)]
            yield record_batch(_OUT, [batch.column("doc_id"), n, high - low, first, last, [",".join(sorted(x)) for x in base],
                                      [",".join(sorted(x)) for x in more], score, [len(x) for x in blocks],
                                      [",".join(sorted(x - y)) for x, y in zip(doubt, more, strict=True)]])

    return docs.mapInArrow(rows, _OUT_DDL)
