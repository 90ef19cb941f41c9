"""Exact merge-type (BPE) encoding with a SentencePiece vocabulary, by backtracking.

A text is encoded without merging it step by step: an Aho-Corasick automaton gives the longest piece that starts at each
place, a piece may follow another only if re-merging the two joined gives just these two, and places from which no
encoding goes on are bits of a field. White space starts a unit: no piece of the vocabulary has white space after
another character (checked when the model is loaded), so units are encoded alone and kept in a memo of bounded size. Runs of blanks are
pieces of one score, the least of all: they merge last, from the left, so a block of the longest such piece can't change any
more and the rest of the run is like a new one (checked too); a run takes time in proportion to its length.

Defined results: a null or empty text has only the end id and decodes to the empty text; of any other text, however long, every character is
encoded; repeated rows give equal rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import each_batch, text_list

SPACE = "▁"
UNIT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
#: Characters of the units that are kept, and the longest such unit.
MEMO_CHARS, MEMO_UNIT = 4_000_000, 64
FITS = 500_000
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class PieceCodec:
    """Encoder and decoder of a BPE model with byte fallback and identity normalisation."""

    def __init__(self, model_file: str):
        from sentencepiece import sentencepiece_model_pb2 as spec

        model = spec.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("the model must be of type BPE, with identity normalisation, a dummy prefix and kept white space")
        self.unk, self.end = model.trainer_spec.unk_id, model.trainer_spec.eos_id
        self.score: dict[str, float] = {}
        self.number: dict[str, int] = {}
        self.surface: list[str | None] = []
        self.byte: dict[int, int] = {}
        byte_id = {}
        for i, p in enumerate(model.pieces):
            self.surface.append(p.piece if p.type == 1 else None)
            if p.type == 1:
                self.score[p.piece], self.number[p.piece] = p.score, i
            elif p.type == 6:
                byte_id[int(p.piece[3:5], 16)] = i
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.score):
            raise ValueError("a piece has white space after another character")
        self.byte_id = byte_id
        self.byte = {i: b for b, i in byte_id.items()}
        # Pieces that no order of merges builds can never come out of an encoding.
        self.whole = {p for p in self.score if len(p) == 1 or self.merged(p) == [p]}
        self.longest = ahocorasick.Automaton()
        for p in self.whole:
            self.longest.add_word(p, p)
        self.longest.make_automaton()
        self.shorter: dict[str, str | None] = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.whole), None) for p in self.whole}
        self.fits: dict[tuple[str, str], bool] = {}
        self.memo: dict[str, tuple[str, str]] = {}
        self.memo_chars = 0
        blank = {p: s for p, s in self.score.items() if not p.strip(SPACE) and len(p) > 1}
        self.most = max(map(len, blank), default=1)
        self.blanks = [self.merged(SPACE * n) for n in range(2 * self.most)]
        if blank and (len(set(blank.values())) > 1 or any(s <= max(blank.values()) for p, s in self.score.items() if len(p) > 1 and p not in blank)):
            raise ValueError("runs of blanks must have one score, less than all others")
        if any(self.blanks[self.most + n] != [SPACE * self.most, *self.blanks[n]] for n in range(self.most)) or any(p.startswith(SPACE * 2) and p not in blank for p in self.score):
            raise ValueError("runs of blanks must merge in blocks of the longest one, and with nothing else")

    def merged(self, text: str) -> list[str]:
        """The pieces after all merges, best score first and leftmost among equals; the definition itself."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, a: str, b: str) -> bool:
        found = self.fits.get((a, b))
        if found is None:
            found = self.merged(a + b) == [a, b]
            if len(self.fits) < FITS:
                self.fits[a, b] = found
        return found

    def unit_pieces(self, unit: str) -> list[str]:
        """The pieces of one unit; a character without a piece stands alone."""
        if unit.startswith(SPACE * 2):
            word = unit.lstrip(SPACE)
            rest = self.unit_pieces(SPACE + word) if word else []
            n = len(unit) - len(word)
            if rest and rest[0] != SPACE:
                n -= 1  # the last blank has merged with the word
            else:
                rest = rest[1:]
            return [SPACE * self.most] * (n // self.most) + self.blanks[n % self.most] + rest
        n, longest = len(unit), {}
        for end, p in self.longest.iter(unit):
            start = end - len(p) + 1
            if len(longest.get(start, "")) < len(p):
                longest[start] = p
        out: list[str] = []
        at, failed, given = 0, bytearray(n // 8 + 1), None  # given: the piece to try next, when one was taken back
        floor = 0  # nothing merges over a character without a piece
        while at < n:
            piece = given or longest.get(at)
            given = None
            if piece is None:
                out.append(unit[at])
                at += 1
                floor = len(out)
                continue
            while piece is not None and (failed[(at + len(piece)) >> 3] >> (at + len(piece) & 7) & 1 or (len(out) > floor and not self.follows(out[-1], piece))):
                piece = self.shorter[piece]
            if piece is not None:
                out.append(piece)
                at += len(piece)
                continue
            failed[at >> 3] |= 1 << (at & 7)
            if len(out) == floor:
                raise ValueError(f"no encoding of {unit!r}")
            at -= len(given := out.pop())
        return out

    def unit_ids(self, unit: str) -> list[int]:
        out = []
        for p in self.unit_pieces(unit):
            i = self.number.get(p)
            if i is None:
                out.extend(self.byte_id[b] for b in p.encode())
            else:
                out.append(i)
        return out

    @staticmethod
    def units(text: str) -> list[str]:
        """Each with its leading white space; the dummy prefix belongs to the first."""
        if not text:
            return []
        if "  " in text or text[0] == " " or text[-1] == " " or SPACE in text:
            return UNIT.findall(SPACE + text.replace(" ", SPACE))
        return text.split(" ")

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for u in self.units(text):
            out.extend(self.unit_ids(u if u.startswith(SPACE) else SPACE + u))
        return [*out, self.end]

    def decode_raw(self, ids: list[int]) -> str:
        out, run = [], bytearray()
        for i in ids:
            b = self.byte.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            if self.surface[i] is not None:
                out.append(self.surface[i])
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out).replace(SPACE, " ")

    def decode(self, ids: list[int]) -> str:
        text = self.decode_raw(ids)
        return text[1:] if text[:1] == " " else text

    def digest_parts(self, text: str) -> tuple[str, str]:
        """(decimal ids joined by spaces, decoded text) of a whole text."""
        memo, ids, back = self.memo, [], []
        for u in self.units(text):
            hit = memo.get(u)
            if hit is None:
                found = self.unit_ids(u if u.startswith(SPACE) else SPACE + u)
                hit = (" ".join(map(str, found)), self.decode_raw(found))
                if len(u) <= MEMO_UNIT and self.memo_chars < MEMO_CHARS:
                    memo[u] = hit
                    self.memo_chars += len(u)
            ids.append(hit[0])
            back.append(hit[1])
        ids.append(str(self.end))
        text = "".join(back)
        return " ".join(ids), text[1:] if text[:1] == " " else text


@lru_cache(maxsize=2)
def codec(model_file: str) -> PieceCodec:
    return PieceCodec(model_file)


def encode_table(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and of the text decoded from them."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, counts, ids_hash, text_hash = codec(model_file), [], [], []
        for text in text_list(batch.column("text")):
            ids, back = own.digest_parts(text)
            counts.append(ids.count(" ") + 1)
            ids_hash.append(hashlib.sha256(ids.encode()).hexdigest())
            text_hash.append(hashlib.sha256(back.encode()).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_hash), pa.array(text_hash)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(each_batch(run), SCHEMA)
