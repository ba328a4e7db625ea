"""Small LaTeX documents and critiques."""

DOCUMENTS = {
    "main.tex": r"""\documentclass[11pt]{article}
\usepackage[utf8]{inputenc}
\usepackage{local}
\newcommand{\term}[1]{\emph{#1}}
\def\pair#1#2{(#1, #2)}
% a comment
\begin{document}
\section{Introduction}\label{sec:intro}
Hello world, this is the \textbf{first} paragraph with $x^2$ and \cite{one}.

The second refers to \ref{sec:intro} and to \href{https://example.org}{a page}.
\begin{equation}
E = mc^2
\end{equation}
\begin{itemize}
\item An item about \textcolor{red}{colours}
\item Another \unknownmacro one
\end{itemize}
\input{chapters/one}
\end{document}
""",
    "chapters/one.tex": "\\subsection{One}\nPlain words here.\n\n\\verb|\\end{x}| and \\includegraphics[width=3cm, alt={a small dog}]{dog}.\n\n\\noindent\\emph{Split here}\n\\input{chapters/two}\n",
    "chapters/two.tex": "\\textbf{never closed\n\n\\input{main}\n",
    "local.sty": "\\newcommand\\be{\\begin{equation}}\n",
    "empty.tex": "",
}
CRITIQUES = {
    "fenced": 'Thinking.\n```json\n{"requires_refine": true, "issues": [{"category": "fluency", "description": "stiff"}]}\n```',
    "nested": 'First {"a": {"b": 1}} then {"requires_refine": false, "issues": []}',
    "quotes": '{"requires_refine": true, "issues": [{"category": "accuracy", "description": "lost <macro id="1"/>"}]}',
    "odd issues": '{"requires_refine": true, "issues": [{"category": "nope"}]}',
    "prose": "Looks fine to me.",
    "empty": "",
}
