"""The analytic operators, one module per business area."""
