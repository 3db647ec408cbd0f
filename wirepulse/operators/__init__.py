"""DataFrame -> DataFrame operators; every operator is lazy unless its docstring says otherwise."""
