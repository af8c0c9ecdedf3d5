"""Errors with stable codes."""

# The codes of refusals.
CODES = frozenset(
    """
    parametro_invalido filtro_invalido filtro_indisponivel precedente_nao_servido consulta_invalida limite_invalido data_invalida
    tribunal_invalido processo_invalido campo_indisponivel componente_indisponivel documento_nao_encontrado versao_indisponivel versao_retirada
    documento_alterado cursor_invalido base_alterada publicacao_expirada publicacao_invalida referencia_excede_orcamento base_indisponivel
    base_nao_inicializada erro_interno
    """.split()
)


class EngineError(ValueError):
    """A refusal: ``code`` is stable, the message says what to do."""

    def __init__(self, code: str, message: str):
        if code not in CODES:
            raise ValueError(f"{code} is no code of a refusal")
        super().__init__(message)
        self.code, self.message = code, message
