#: NULL, empty and blank texts, a NULL id, a repeated row, ties, one very long text
ODD = [(None, "alpha beta gamma delta epsilon zeta"), (1, None), (2, ""), (3, " \n\t "), (4, "alpha beta"),
       (4, "alpha beta"), (5, "Alpha Beta gamma delta epsilon zeta"), (6, "alpha beta gamma delta epsilon zeta"),
       (7, " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))), (8, "12 34 #$ |"), (9, "a" * 5000)]
