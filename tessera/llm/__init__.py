"""Operations of a training-data pipeline over corpora of documents.

Nothing else in the library imports this subpackage.
"""
