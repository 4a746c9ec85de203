from dishlens.functions import hashing, lexicon, text, vectors

__all__ = ["hashing", "lexicon", "text", "vectors"]
