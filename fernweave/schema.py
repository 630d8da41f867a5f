"""Schemas, declared and never inferred."""

from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, IntegerType, LongType, MapType, StringType, StructType

_TEXTS, _NOTES = ArrayType(StringType()), MapType(StringType(), StringType())


def _schema(**columns: DataType) -> StructType:
    out = StructType()
    for name, kind in columns.items():
        out = out.add(name, kind)
    return out


S, I, L = StringType(), IntegerType(), LongType()
DOCUMENT = _schema(doc_id=S, title=S, text=S, source=S, metadata=_NOTES)
#: pos is the position of insertion: it breaks ties of scores.
CHUNK = _schema(chunk_id=S, doc_id=S, title=S, text=S, ordinal=I, source=S, metadata=_NOTES, pos=L)
QUESTION = _schema(id=S, type=S, question=S, relevant_sources=_TEXTS, answer_keywords=_TEXTS, answerable=BooleanType())
#: One row for each hit of a question; a ranking has any number of sources.
HIT = _schema(qid=S, chunk_id=S, score=DoubleType(), rank=I)
ANSWER = _schema(qid=S, question=S, text=S, cited_ordinals=ArrayType(I), abstained=BooleanType(), usage=MapType(S, I), engine=S, notice=S)
