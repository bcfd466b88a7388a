"""The pieces of a public SentencePiece model file, read on the driver and sent to the tasks (at most a few MB)."""

from __future__ import annotations

#: Only read from here; a parameter of every operator that needs it.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"


def load_pieces(model: str = MODEL) -> tuple[list[tuple[int, str, float]], dict[int, int]]:
    """(id, piece, score) of the ordinary pieces; id of the piece for each byte, if the model has them."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    plain, byte = [], {}
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            byte[int(sp.id_to_piece(i)[3:-1], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            plain.append((i, sp.id_to_piece(i), sp.get_score(i)))
    return plain, byte
