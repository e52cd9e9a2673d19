"""Operations of a large-scale training-data pipeline over document tables.

Every operator takes a DataFrame with ``doc_id`` and ``text`` (WARC: ``page_id``, ``url``,
``html``), ignores further columns unless it says otherwise, and treats a null text as stated in
its docstring.  Nothing outside this package imports it.
"""
