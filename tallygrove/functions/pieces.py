"""The first stage of a byte-pair tokenizer: text to pieces, on the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallygrove.functions.text import WHITE_SPACE as W

# The special tokens of the cl100k vocabulary, which are one token each.
SPECIAL_TOKENS = (
    "<|endoftext|>",
    "<|fim_prefix|>",
    "<|fim_middle|>",
    "<|fim_suffix|>",
    "<|endofprompt|>",
)
_SPECIAL = rf"<\|(?:{'|'.join(token[2:-2] for token in SPECIAL_TOKENS)})\|>"

# The public cl100k split pattern, its \s written out as White_Space and its
# ignore-case suffixes written as classes (long s included), so that no flag is needed.
# Special tokens end the text before them: no punctuation run goes into one, and blanks
# before one are blanks at an end. Plain words, the commonest pieces, are tried first.
PIECE_PATTERN = (
    r"[ ]?+\p{L}++"
    rf"|{_SPECIAL}"
    r"|'(?:[sSſtTmMdD]|[rR][eE]|[vV][eE]|[lL][lL])"
    r"|[^\r\n\p{L}\p{N}]?+\p{L}++"
    r"|\p{N}{1,3}+"
    rf"| ?(?:(?!{_SPECIAL})[^{W}\p{{L}}\p{{N}}])++[\r\n]*+"
    rf"|[{W}]*[\r\n]++"
    rf"|[{W}]++(?={_SPECIAL})"
    rf"|[{W}]+(?![^{W}])"
    rf"|[{W}]++"
)


def pieces(text: Column) -> Column:
    """Pieces and special tokens, in order."""
    return F.regexp_extract_all(text, F.lit(PIECE_PATTERN), F.lit(0))


def piece_count(text: Column) -> Column:
    """Their number: a lower bound of the token count that needs no vocabulary.

    The pieces cover the text, so that with one letter put for each the length is their
    number. A list of them would take many times the memory of a large text.
    """
    return F.length(F.regexp_replace(text, PIECE_PATTERN, "x")).cast("bigint")
