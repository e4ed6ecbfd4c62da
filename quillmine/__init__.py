"""quillmine: code search and code intelligence over DataFrames."""
