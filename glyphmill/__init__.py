"""glyphmill: text corpora to unit vectors, written as Spark DataFrame jobs."""

from glyphmill.model import TextModel
from glyphmill.operators.distinct import embed_distinct
from glyphmill.operators.embed import Encoder, OnnxEncoder, embed, encode
from glyphmill.operators.lexicon import Lexicon, build_lexicon
from glyphmill.operators.tokens import detokenize, encode_ids, token_table, tokenize
from glyphmill.sources.vocabulary import SpecialTokens, Vocabulary

__all__ = [
    "Encoder",
    "Lexicon",
    "OnnxEncoder",
    "SpecialTokens",
    "TextModel",
    "Vocabulary",
    "build_lexicon",
    "detokenize",
    "embed",
    "embed_distinct",
    "encode",
    "encode_ids",
    "token_table",
    "tokenize",
]
