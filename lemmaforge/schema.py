"""Tag sets, character maps and schemas that the stages share."""

from __future__ import annotations

#: Their order is the number of the class in a tagger's output.
UPOS = "NOUN PROPN VERB ADJ ADV PRON DET ADP NUM AUX CCONJ SCONJ PART INTJ X".split()
#: Blanked on request; interjections belong here but not to the closed classes below.
FUNCTION_POS = ["ADP", "AUX", "CCONJ", "DET", "INTJ", "PART", "PRON", "SCONJ"]
CLOSED_POS = ["ADP", "AUX", "CCONJ", "DET", "PART", "PRON", "SCONJ"]

#: Typographic quotes and primes, code point by code point, and their ASCII forms.
QUOTES = "“”„‟«»″״‘’‚‛′׳"
PLAIN_QUOTES = '"' * 8 + "'" * 6

FINALS, MEDIALS = "ךםןףץ", "כמנפצ"
SEP = "¦"
IDENTITY = f"0{SEP}{SEP}0{SEP}"

#: Lexicon word classes and the tags a tagger may give to such a word.
CLASS_TAGS = {
    "adjective": ["ADJ"],
    "adverb": ["ADV"],
    "conjunction": ["CCONJ", "SCONJ"],
    "copula": ["AUX", "PRON", "VERB"],
    "demonstrative": ["DET", "PRON"],
    "existential": ["VERB", "AUX"],
    "interrogative": ["PRON", "DET"],
    "modal": ["AUX", "VERB"],
    "negation": ["PART", "ADV"],
    "noun": ["NOUN"],
    "numeral": ["NUM"],
    "participle": ["VERB", "ADJ", "NOUN"],
    "passiveParticiple": ["VERB", "ADJ"],
    "preposition": ["ADP"],
    "pronoun": ["PRON"],
    "quantifier": ["DET"],
    "verb": ["VERB"],
}

TOKENS = "array<struct<sent_id:int,token:string,start:int,end:int,nospace:boolean>>"
DOC = "text string, tokens array<struct<token:string,start:int,end:int,lemma:string,pos:string,source:string,score:double,sent_id:int>>, analyzed_text string, es_tokens array<struct<token:string,start_offset:int,end_offset:int,position:int,type:string>>, unknown array<struct<token:string,lemma:string,pos:string,count:long>>"
