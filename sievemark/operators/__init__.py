"""Row-level operators: the value kernel, Column builders and output documents."""
