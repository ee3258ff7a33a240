"""Column expressions; everything here stays inside whole-stage code generation unless a docstring says otherwise."""
