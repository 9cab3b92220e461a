"""Training-data pipeline operators; each module holds one operator and its docstring states the defined results."""
