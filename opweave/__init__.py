"""opweave: a linear and nonlinear operator algebra over Spark DataFrames.

``I`` and ``O`` are the identity and zero, ``X`` a variable for printing expressions.
"""


def __getattr__(name: str):
    if name == "I":
        from opweave.operators.diagonal import IdentityOperator

        return IdentityOperator()
    if name == "O":
        from opweave.operators.diagonal import ZeroOperator

        return ZeroOperator()
    if name == "X":
        from opweave.expr import Variable

        return Variable("X")
    raise AttributeError(name)
