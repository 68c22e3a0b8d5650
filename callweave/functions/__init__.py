"""Column builders: scalar rules, INFO fields, breakend notation, pair predicates."""
