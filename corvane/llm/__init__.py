"""Operations of a training-data pipeline over a table of documents.

Nothing outside this package imports it.  Every operator reads whole texts and
whole tables; what a class of operators collects on the driver is bounded by a
documented parameter and never grows with the documents.
"""
