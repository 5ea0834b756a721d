"""Public tokenizer vocabularies, read on the driver and sent to the executors by broadcast.

The files have a fixed size of a few MB, whatever the corpus, so their broadcast is bounded.
"""

from __future__ import annotations

import json
import os
import re
import zlib

from babelyard.llm import workers

WORD_BPE = "word_bpe_49k.json"
SPACE = re.compile(r"[ \t\n\r\f\v]+")


def vocabulary_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def whole_words(vocabulary: str) -> list[str]:
    """The vocabulary's whole words of ASCII letters, in its own order: from common to rare."""
    tokens = json.loads(vocabulary)["model"]["vocab"]
    ends = (t[:-4] for t in sorted(tokens, key=tokens.get) if t.endswith("</w>"))
    return list(dict.fromkeys(w for w in ends if re.fullmatch("[a-z]+", w)))


#: Letters whose lower case and composed form are the same for every library.
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ſ"
PLAIN = re.compile(f"[{LETTERS}]+|[^{LETTERS} \t\n\r\f\v]+")
#: PLAIN for lower-cased ASCII texts.
PLAIN_ASCII = re.compile("[a-z]+|[^a-z \t\n\r\f\v]+")
WORD = re.compile(f"[{LETTERS}]+")
#: What makes a cut between letters and other characters unsafe: contractions, letters outside LETTERS, special tokens.
UNSAFE = re.compile("['ªµºİ\u0180-\U0010ffff]|<\\|")
END = "\x00"


def byte_letters() -> dict[str, int]:
    """The letters by which a byte-level vocabulary writes bytes: printable ones stand for
    themselves, the others follow from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class WordCoder:
    """Ids of plain words by a faster library, from the same vocabulary.

    The merges of the vocabulary are in the order of its ids, and each token has one merge, so the
    lowest id of a joined pair is the next merge. The end of a word is a zero byte; a byte and
    that end join before all else, since those ids come before the merges' ids.
    """

    def __init__(self, vocabulary: str):
        import tiktoken

        model, letters = json.loads(vocabulary)["model"], byte_letters()
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.usable = len(set(merged)) == len(merged) and all(model["vocab"].get(m) == 512 + k for k, m in enumerate(merged))
        if not self.usable:
            return
        ranks = {}
        for token, number in model["vocab"].items():
            body, end = (token[:-4], b"\0") if token.endswith("</w>") and len(token) > 4 else (token, b"")
            if all(c in letters for c in body):
                ranks[bytes(letters[c] for c in body) + end] = number
        import numpy as np

        self.coder = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
        self.ends = np.zeros(max(ranks.values()) + 1, dtype=bool)
        self.ends[[n for t, n in ranks.items() if len(t) > 1 and t.endswith(b"\0")]] = True

    def encode(self, words: list[str]) -> list[bytes]:
        import numpy as np

        ids = np.array(self.coder.encode_ordinary(END.join(words).lower() + END), dtype="<u4")
        ends = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
        own = ids.tobytes()
        return [own[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class CachedEncoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and no token spans it, so a text's ids are those of its parts
    between ASCII white space, one after another; in a text without UNSAFE characters, also those of its runs of
    letters and of others. Parts repeat, so the ids of short ones are kept, up to most_bytes in all; a part of over
    LONGEST_KEPT characters is worked out each time.
    """

    #: What a kept part takes besides its characters and ids.
    ENTRY = 190
    LONGEST_KEPT = 64

    def __init__(self, vocabulary: str, most_bytes: int = 48 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.words = Tokenizer.from_str(vocabulary), WordCoder(vocabulary)
        self.most_bytes, self.bytes, self.known = most_bytes, 0, {}

    def parts(self, text: str) -> list[str]:
        if text.isascii():
            return SPACE.split(text) if "'" in text or "<|" in text else PLAIN_ASCII.findall(text.lower())
        return SPACE.split(text) if UNSAFE.search(text) else PLAIN.findall(text)

    def learn(self, parts: set[str]) -> set[str]:
        """Those of the parts that were not known, which now are."""
        import numpy as np

        if self.bytes > self.most_bytes:
            self.known, self.bytes = {}, 0
        new = parts.difference(self.known)
        plain = [p for p in new if (p.isalpha() if p.isascii() else WORD.fullmatch(p))] if self.words.usable else []
        for at in range(0, len(plain), 4096):
            some = plain[at : at + 4096]
            self.known.update(zip(some, self.words.encode(some), strict=True))
        rest = list(new.difference(plain))
        for at in range(0, len(rest), 4096):
            some = rest[at : at + 4096]
            for part, coded in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.known[part] = np.array(coded.ids, dtype="<u4").tobytes()
        self.bytes += self.ENTRY * len(new) + 3 * sum(map(len, new))
        return new

    def encode(self, texts: list[str | None], group: int = 64):
        """Yields each text's ids, in order."""
        for at in range(0, len(texts), group):
            parts = [self.parts(t) if t else [] for t in texts[at : at + group]]
            new = self.learn(set().union(*parts))
            get = self.known.__getitem__
            for own in parts:
                yield b"".join(map(get, own))
            for p in new:  # a long part is never kept, so it is among the new ones
                if len(p) > self.LONGEST_KEPT:
                    del self.known[p]
                    self.bytes -= self.ENTRY + 3 * len(p)


def encoder(vocabulary: str) -> CachedEncoder:
    """The worker's encoder of this vocabulary."""
    return workers.hold(("encoder", vocabulary), lambda: CachedEncoder(vocabulary))


def crc(ids: memoryview) -> int:
    return zlib.crc32(ids) & 0xFFFFFFFF
