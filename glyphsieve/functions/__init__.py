"""Column functions: text in, columns out. Built-ins wherever they can say it, Arrow functions elsewhere."""
