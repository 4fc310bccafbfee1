"""SQL text for a logistic regression by Newton steps, to check fitted models against."""


def newton(rows: str, columns, penalty, steps: int = 8, prefix: str = "") -> str:
    """Views that end in ``fitted(b0, b1, ...)`` (names after ``prefix``): minimum of sum(w * log loss) + penalty/2 * |b|^2
    over the view ``rows`` with the columns given, a 0/1 column ``y`` and a weight ``w``."""
    n = len(columns)
    score = " + ".join(f"b{i} * {c}" for i, c in enumerate(columns))
    views = [f"{prefix}n0 as (select {', '.join(f'0.0e0 as b{i}' for i in range(n))})"]
    for step in range(1, steps + 1):
        bs = ", ".join(f"any_value(b{i}) as b{i}" for i in range(n))
        gradient = ", ".join(
            f"sum(w * (q - y) * {columns[i]}) + {penalty[i]}e0 * any_value(b{i}) as m{i}_{n}" for i in range(n)
        )
        hessian = ", ".join(
            f"sum(w * q * (1 - q) * {columns[i]} * {columns[j]}) + {penalty[i] if i == j else 0}e0 as m{i}_{j}"
            for i in range(n)
            for j in range(n)
        )
        text = (
            f"select {bs}, {hessian}, {gradient} from "
            f"(select r.*, {prefix}n{step - 1}.*, 1 / (1 + exp(-({score}))) as q from {rows} r, {prefix}n{step - 1}) t"
        )
        # Gauss-Jordan elimination, one pivot per layer
        for k in range(n):
            cells = []
            for i in range(n):
                for j in range(k + 1, n + 1):
                    scaled = f"m{k}_{j} / m{k}_{k}"
                    cells.append(f"{scaled} as m{i}_{j}" if i == k else f"m{i}_{j} - m{i}_{k} * {scaled} as m{i}_{j}")
            text = f"select {', '.join(f'b{i}' for i in range(n))}, {', '.join(cells)} from ({text}) e{k}"
        update = ", ".join(f"b{i} - m{i}_{n} as b{i}" for i in range(n))
        views.append(f"{prefix}n{step} as (select {update} from ({text}) s)")
    views.append(f"{prefix}fitted as (select * from {prefix}n{steps})")
    return ",\n".join(views)


def newton_grid(rows: str, columns, candidates: str, steps: int = 10, free=(), prefix: str = "") -> str:
    """Views that end in ``grid(k, i, b0, b1, ...)`` (names after ``prefix``): the same for every fold ``k`` left out and
    every candidate. The view ``rows`` has k, f (the row's own fold), y and the columns as fitted for k,
    the view ``candidates`` has i, strength (of half the squared weights, but those of ``free``) and balanced."""
    n, g = len(columns), f"{prefix}g"
    score = " + ".join(f"b{i} * {c}" for i, c in enumerate(columns))
    held = ["0" if c in free else "strength" for c in columns]
    views = [
        f"{prefix}tr as (select * from {rows} where f <> k)",
        f"{prefix}class as (select k, count(*) as n, sum(y) as n1 from {prefix}tr group by k)",
        f"{g}0 as (select k, i, strength, case when balanced then n / (2 * n1) else 1.0e0 end as w1, "
        f"case when balanced then n / (2 * (n - n1)) else 1.0e0 end as w0, "
        f"{', '.join(f'0.0e0 as b{i}' for i in range(n))} from {prefix}class, {candidates})",
    ]
    own = ", ".join(["k", "i", "strength", "w1", "w0", *[f"b{i}" for i in range(n)]])
    for step in range(1, steps + 1):
        sums = [f"sum(w * (q - y) * {columns[i]}) + {held[i]} * b{i} as m{i}_{n}" for i in range(n)]
        sums += [
            f"sum(w * q * (1 - q) * {columns[i]} * {columns[j]}) + {held[i] if i == j else '0'} as m{i}_{j}"
            for i in range(n)
            for j in range(n)
        ]
        text = (
            f"select {own}, {', '.join(sums)} from (select r.* exclude (k), s.*, 1 / (1 + exp(-({score}))) as q, "
            f"case when y = 1 then w1 else w0 end as w from {prefix}tr r join {g}{step - 1} s on r.k = s.k) t group by {own}"
        )
        solved = elimination(text, own, n, "d")
        update = ", ".join(f"b{i} - d{i} as b{i}" for i in range(n))
        views.append(f"{g}{step} as materialized (select k, i, strength, w1, w0, {update} from ({solved}) s)")
    views.append(f"{prefix}grid as (select * from {g}{steps})")
    return ",\n".join(views)


def elimination(source: str, keys: str, n: int, name: str = "b") -> str:
    """Query for keys, b0, b1, ...: solutions of n equations, whose rows are m0_0 ... m0_n and so on."""
    text = source
    for k in range(n):
        cells = []
        for i in range(n):
            for j in range(k + 1, n + 1):
                scaled = f"m{k}_{j} / m{k}_{k}"
                cells.append(f"{scaled} as m{i}_{j}" if i == k else f"m{i}_{j} - m{i}_{k} * {scaled} as m{i}_{j}")
        text = f"select {keys}, {', '.join(cells)} from ({text}) e{k}"
    return f"select {keys}, {', '.join(f'm{i}_{n} as {name}{i}' for i in range(n))} from ({text}) s"
