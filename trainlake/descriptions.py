"""Column descriptions for the data dictionary, by column name."""

from __future__ import annotations

SETS = {
    "user_id": "Usuário dono do treino",
    "title": "Nome dado à sessão",
    "description": "Anotação livre da sessão",
    "start_time": "Início da sessão, em UTC",
    "end_time": "Fim da sessão, em UTC",
    "duracao": "Minutos entre início e fim, ou a duração da própria série",
    "exercise_title": "Exercício como o aplicativo o chama",
    "superset_id": "Grupo de exercícios feitos em sequência",
    "exercise_notes": "Anotação do exercício",
    "set_index": "Ordem da série no exercício, a partir de 0",
    "set_type": "Tipo da série, por exemplo aquecimento ou normal",
    "weight_kg": "Carga da série, em kg",
    "reps": "Repetições da série",
    "distance_km": "Distância percorrida, em km",
    "duration_seconds": "Tempo da série, em segundos",
    "rpe": "Esforço percebido",
    "id": "Sessão de origem",
    "id_exercice": "Sessão de origem, como texto",
    "routine_id": "Rotina que originou a sessão",
    "updated_at": "Última alteração na origem",
    "created_at": "Criação na origem",
    "exercises": "Sessão aninhada, como foi recebida",
}

CATALOG = {
    "Exercise Name": "Exercício no catálogo",
    "Main_muscle": "Músculo que mais trabalha",
    "Target_Muscles": "Músculos visados",
    "Synergist_Muscles": "Músculos que ajudam",
    "Equipment": "Equipamento usado",
    "Preparation": "Como se posicionar",
    "Execution": "Como fazer o movimento",
}

MAPPING = {
    "sk_exercise": "Chave do exercício",
    "exercise_title_heavy": "Exercício como o aplicativo o chama",
    "exercise_name_kaggle": "Exercício correspondente no catálogo",
    "score": "Confiança na correspondência",
}

USERS = {
    "user_id": "Código do usuário",
    "data_registro": "Dia em que o formulário foi enviado",
    "nome": "Nome do usuário",
    "email": "Endereço da conta",
    "data_nascimento": "Dia de nascimento",
    "sexo": "Sexo declarado",
    "peso": "Peso, em kg",
    "altura": "Altura, em metros ou centímetros conforme a origem",
    "percentual_gordura": "Gordura corporal, em %",
    "objetivo": "O que o usuário busca com o treino",
    "nivel_treinamento": "Experiência com treino",
    "restricoes_fisicas": "Lesões e limitações",
    "frequencia_semanal": "Dias de treino por semana",
    "horas_sono": "Horas de sono por noite",
    "nutricional_score": "Nota da alimentação",
}
